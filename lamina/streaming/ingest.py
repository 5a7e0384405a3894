"""A stream of edits into a repository: each micro-batch is one commit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.sources.files import Files
from lamina.sources.repository import Repository


def committed(repo: Repository, branch: str, stream: str) -> int:
    """The number of the stream's last batch on the branch's first-parent line, or -1.
    Whatever others have committed since does not hide it."""
    head = repo.ref(branch)
    if head is None:
        return -1
    start = f"stream {stream} batch "
    found = repo.log(branch).where(F.startswith("message", F.lit(start))).select("message").collect()
    return max((int(r.message[len(start) :]) for r in found), default=-1)


def commit_batches(edits: DataFrame, repo: Repository, branch: str, checkpoint: str, order: str = "seq", author: str = "stream") -> StreamingQuery:
    """Start the query.  ``edits`` streams ``keys, values, is_delete`` and ``order``.

    A commit carries the stream's id (that of its checkpoint, which outlives restarts) and
    the batch's number.  A batch that is replayed after a failure finds them on the branch
    and is not committed again; batches of other streams and commits of other writers do
    not matter.  If the branch moves under a batch, its edits are laid over the new head."""
    spark = repo.spark

    def one(batch: DataFrame, number: int) -> None:
        stream = json.loads(Files(spark, checkpoint).read("metadata"))["id"]
        if committed(repo, branch, stream) >= number:
            return
        repo.update_edits(branch, batch, author, f"stream {stream} batch {number}", order)

    return edits.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
