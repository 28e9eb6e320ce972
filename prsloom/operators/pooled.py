"""Samplers over blocks that stay where they are.

The blocks of a panel are dealt to the tasks of one barrier stage, which run together. Every task sweeps over its own blocks; what
a sweep pools (counts, sums of squares, products of annotations) is a short vector, which the tasks add up over sockets:
task 0 listens, the others send theirs and get the total. No block, no effect and no sample leaves its task before the end. If a
task fails, Spark runs the whole stage again, from the same streams of random numbers.

Where barrier stages cannot run (dynamic allocation), one task holds all blocks.
"""

from __future__ import annotations

import secrets
import socket
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

from prsloom.functions.kernels import alone
from prsloom.tables import written

#: Seconds that a task waits for the others of its stage.
PATIENCE = 3600


def _send(to: socket.socket, values: np.ndarray) -> None:
    raw = np.ascontiguousarray(values, np.float64).tobytes()
    to.sendall(struct.pack("<Q", len(raw)) + raw)


def _take(source: socket.socket, many: int) -> bytes:
    out = bytearray()
    while len(out) < many:
        part = source.recv(min(many - len(out), 1 << 20))
        if not part:
            raise ConnectionError("a task of the stage is gone")
        out += part
    return bytes(out)


def _receive(source: socket.socket) -> np.ndarray:
    return np.frombuffer(_take(source, struct.unpack("<Q", _take(source, 8))[0]), np.float64)


class Pool:
    """Adds up (or takes the largest of) vectors over the tasks of a barrier stage, in the order of the tasks."""

    def __init__(self, context: BarrierTaskContext):
        infos, self.rank = context.getTaskInfos(), context.partitionId()
        token = secrets.token_bytes(16)
        server = None
        if self.rank == 0:
            server = socket.create_server(("", 0), backlog=len(infos))
            server.settimeout(PATIENCE)
            message = f"{server.getsockname()[1]} {token.hex()}"
        else:
            message = ""
        port, key = context.allGather(message)[0].split()
        self.others: list[socket.socket] = []
        if server is not None:
            by_rank = {}
            while len(by_rank) < len(infos) - 1:
                other, _ = server.accept()
                other.settimeout(PATIENCE)
                hello = _take(other, 24)
                if hello[:16] == token:  # anyone else is hung up on
                    by_rank[struct.unpack("<Q", hello[16:])[0]] = other
                else:
                    other.close()
            self.others = [by_rank[x] for x in sorted(by_rank)]
            server.close()
        else:
            host = infos[0].address.rpartition(":")[0] or infos[0].address
            first = socket.create_connection((host, int(port)), PATIENCE)
            first.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            first.sendall(bytes.fromhex(key) + struct.pack("<Q", self.rank))
            self.others = [first]
        for x in self.others:
            x.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __call__(self, values: np.ndarray, how: str = "sum") -> np.ndarray:
        values = np.asarray(values, np.float64)
        if self.rank:
            _send(self.others[0], values)
            return _receive(self.others[0]).reshape(values.shape)
        total = values.copy().ravel()
        for x in self.others:
            total = (np.add if how == "sum" else np.maximum)(total, _receive(x))
        for x in self.others:
            _send(x, total)
        return total.reshape(values.shape)

    def close(self) -> None:
        for x in self.others:
            x.close()


def tasks(rows: DataFrame, blocks: int) -> int:
    """Tasks of the stage: the slots there are, a block each at least."""
    spark = rows.sparkSession
    if str(spark.conf.get("spark.dynamicAllocation.enabled", "false")).lower() == "true":
        return 1
    return max(1, min(spark.sparkContext.defaultParallelism, blocks))


def run_pooled(rows: DataFrame, blocks: int, schema: str, work: Callable[[list, Callable], Iterator[pd.DataFrame]]) -> DataFrame:
    """A table of what work(rows of a task, pool) yields in all tasks. rows: a row a block."""
    many = tasks(rows, blocks)

    def run(frames):
        held = [x for frame in frames for x in frame.itertuples(index=False)]
        pool = Pool(BarrierTaskContext.get()) if many > 1 else alone
        try:
            yield from work(held, pool)
        finally:
            if many > 1:
                pool.close()

    return written(rows.repartition(many).mapInPandas(run, schema, barrier=many > 1), "chains")
