"""Numbered SQL files that bring a store to its present shape, each applied once, in the order of their numbers."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

from ..functions.exprs import DialectError

NAME = re.compile(r"(\d+)_?(.*)\.sql")


@dataclass(frozen=True)
class Step:
    number: int
    name: str
    checksum: str
    sql: str


def steps(folder: str) -> list[Step]:
    """The folder's files by number. Other files are passed over; a number that two files have is an error."""
    out = []
    for f in sorted(os.listdir(folder)):
        if m := NAME.fullmatch(f):
            with open(os.path.join(folder, f), encoding="utf-8") as file:
                sql = file.read()
            out.append(Step(int(m[1]), m[2], hashlib.sha256(sql.encode()).hexdigest(), sql))
    out.sort(key=lambda s: s.number)
    if twice := [b.number for a, b in zip(out, out[1:]) if a.number == b.number]:
        raise DialectError(f"two migrations have number {twice[0]}")
    return out


def pending(engine, folder: str) -> list[Step]:
    """The steps still to apply. An applied file that has changed or is gone, or a new one before an applied one, is an error."""
    done = {int(n): checksum for n, checksum in engine.store.snapshot().get("ledger", {}).items()}
    known = {s.number: s for s in steps(folder)}
    for n, checksum in sorted(done.items()):
        if n not in known:
            raise DialectError(f"applied migration {n} is gone")
        if known[n].checksum != checksum:
            raise DialectError(f"applied migration {n} has changed")
    left = [s for n, s in known.items() if n not in done]
    if left and done and left[0].number < max(done):
        raise DialectError(f"migration {left[0].number} comes before an applied one")
    return left


def migrate(engine, folder: str, dry_run: bool = False) -> list[Step]:
    """Applies the pending steps and returns them. A step is recorded after its statements, so after a crash it runs again."""
    left = pending(engine, folder)
    for s in [] if dry_run else left:
        engine.execute(s.sql)
        engine.store._commit(lambda state, s=s: state.setdefault("ledger", {}).update({str(s.number): s.checksum}))
    return left
