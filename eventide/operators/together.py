"""Synchronous training: tasks of one barrier stage keep their rows in memory and sum up vectors between them, step by step.

All steps run in one job. If a task is lost, Spark runs the whole stage again, from what the caller gave it to start with.
"""

from __future__ import annotations

import secrets
import socket
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame


#: Seconds that a task waits for another one.
PATIENCE = 600


class Group:
    """The tasks of a stage. Sums are over the tasks in their order, so each has the same numbers to the last bit.

    Spark's own exchange between barrier tasks takes a second a call: it tells the tasks where the first one listens, and
    sums then go to it and back by sockets. A task that is lost closes its socket, so that the others fail too.
    """

    def __init__(self, context: BarrierTaskContext):
        infos, self.rank = context.getTaskInfos(), context.partitionId()
        self.size = len(infos)
        self._peers: list[socket.socket] = []
        if self.size == 1:
            return
        server = socket.create_server(("", 0)) if self.rank == 0 else None
        told = f"{infos[0].address.rsplit(':', 1)[0]} {server.getsockname()[1]} {secrets.token_hex(16)}" if server else ""
        host, port, token = context.allGather(told)[0].split()
        if server:
            server.settimeout(PATIENCE)
            found: dict[int, socket.socket] = {}
            while len(found) < self.size - 1:
                peer, _ = server.accept()
                self._ready(peer)
                said, rank = _received(peer, 36).decode().split()
                if secrets.compare_digest(said[:32], token):
                    found[int(rank)] = peer
            server.close()
            self._peers = [found[r] for r in sorted(found)]
        else:
            peer = socket.create_connection((host, int(port)), PATIENCE)
            self._ready(peer)
            peer.sendall(f"{token} {self.rank:3}".encode())
            self._peers = [peer]

    @staticmethod
    def _ready(peer: socket.socket) -> None:
        peer.settimeout(PATIENCE)
        peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def sum(self, values: np.ndarray) -> np.ndarray:
        """Of the arrays that all tasks give, which have one shape and type."""
        if self.size == 1:
            return values
        own = np.ascontiguousarray(values)
        if self.rank:
            self._peers[0].sendall(own.tobytes())
            return np.frombuffer(_received(self._peers[0], own.nbytes), own.dtype).reshape(own.shape)
        out = own.copy()
        for peer in self._peers:
            out += np.frombuffer(_received(peer, own.nbytes), own.dtype).reshape(own.shape)
        for peer in self._peers:
            peer.sendall(out.tobytes())
        return out

    def close(self) -> None:
        for peer in self._peers:
            peer.close()


def _received(peer: socket.socket, size: int) -> bytes:
    parts = bytearray()
    while len(parts) < size:
        some = peer.recv(min(size - len(parts), 1 << 20))
        if not some:
            raise ConnectionError("a task of the stage is gone")
        parts += some
    return bytes(parts)


def trained(rows: DataFrame, tasks: int, schema: str, train: Callable[[list[pa.RecordBatch], Group], pa.RecordBatch]) -> DataFrame:
    """What ``train`` returns of the rows of each of ``tasks`` tasks and their :class:`Group`, that of the first task.

    The cluster must have so many free slots at once, and each task holds its rows: ``tasks`` bounds what one has to hold.
    A table without rows gives an empty list of batches.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(BarrierTaskContext.get())
        try:
            made = train([b for b in batches if b.num_rows], group)
        finally:
            group.close()
        if group.rank == 0:
            yield made

    return rows.repartition(tasks).mapInArrow(run, schema, barrier=True)


def tasks_for(rows: int, width: int, slots: int, task_bytes: int, task_rows: int) -> int:
    """One task for each ``task_rows`` rows, as far as there are ``slots`` for them all at once.

    Those slots must hold ``rows`` of ``width`` doubles within ``task_bytes`` each, or it raises RuntimeError.
    """
    least = max(1, -(-rows * width * 8 // task_bytes))
    if least > slots:
        raise RuntimeError(f"{rows} rows of {width} numbers need {least} tasks of {task_bytes} bytes at once, but there are {slots} slots")
    return max(least, min(slots, -(-rows // task_rows)))
