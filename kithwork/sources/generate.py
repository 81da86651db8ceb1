"""Seeded random queries over a network, for property tests and load."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwork.sources.tables import Network

#: Values that a parameter is drawn from, at most.
POOL = 1000


def _pool(rows: DataFrame, column: str, seed: int) -> list:
    """Up to POOL values of ``column``, the same for the same seed."""
    return [r[0] for r in rows.select(column).distinct().orderBy(F.xxhash64(F.col(column), F.lit(seed)), column).limit(POOL).collect()]


def query_lines(net: Network, n: int, seed: int) -> list[str]:
    """``n`` lines of each query type in random order. Names with white space are left out: the format cannot hold them."""
    rng = random.Random(seed)
    persons = _pool(net.person, "person_id", seed)
    named = lambda rows: [x for x in _pool(rows, "name", seed) if x and not any(c.isspace() or c in ",()" for c in x)]
    places, tags = named(net.place), named(net.tag.join(net.forum_tag, "tag_id", "left_semi"))
    out = []
    for _ in range(n):
        if persons:
            out.append(f"query1({rng.choice(persons)}, {rng.choice(persons)}, {rng.randint(-1, 4)})")
        out.append(f"query2({rng.randint(1, 8)}, {rng.randint(1980, 2000)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d})")
        if places:
            out.append(f"query3({rng.randint(1, 8)}, {rng.randint(1, 7)}, {rng.choice(places)})")
        if tags:
            out.append(f"query4({rng.randint(1, 7)}, {rng.choice(tags)})")
    rng.shuffle(out)
    return out
