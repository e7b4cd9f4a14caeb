"""A newest-to-oldest fold in plain Python, which plans are held against on random logs."""

from __future__ import annotations

import random


def random_log(seed: int, n: int = 200, keys: int = 12):
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        op = rng.choice(["PUT", "PUT", "MERGE", "MERGE", "MERGE", "DELETE", "RANGE_DELETE" if rng.random() < 0.3 else "MERGE"])
        k = rng.randrange(keys)
        rows.append(("cf", k, seq, op, None if op in ("DELETE", "RANGE_DELETE") else rng.randrange(100), k + rng.randrange(0, 4) if op == "RANGE_DELETE" else None, seq * 10))
    rng.shuffle(rows)
    return rows


SCHEMA = "cf string, key bigint, seq bigint, op string, value bigint, end_key bigint, ts bigint"


def state(rows, snapshot=None, read_ts=None, ranges=True):
    """key -> (value, newest seq, operands oldest first, base)."""
    seen = [r for r in rows if (snapshot is None or r[2] <= snapshot) and (read_ts is None or r[6] <= read_ts)]
    tombs = [r for r in seen if r[3] == "RANGE_DELETE"] if ranges else []
    out = {}
    for key in {r[1] for r in seen}:
        cover = max((t[2] for t in tombs if t[1] <= key < t[5]), default=0)
        operands, base, newest, found = [], None, None, False
        for _, _, seq, op, value, _, _ in sorted((r for r in seen if r[1] == key and r[3] != "RANGE_DELETE"), key=lambda r: -r[2]):
            if seq < cover:
                break
            newest = newest or seq
            if op == "MERGE":
                operands.append(value)
                found = True
                continue
            if op == "PUT":
                base, found = value, True
            break
        if found:
            operands.reverse()
            out[key] = ((base if not operands else (base or 0) + sum(operands)), newest, operands, base)
    return out
