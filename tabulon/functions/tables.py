"""User aggregates with any mergeable state, and table functions.

An aggregate's states are bytes: tasks make one per key, and they are merged in a tree whose
inner nodes take a bounded number of them. Rows are sorted by key before a merge, so a task holds
one state at a time, however many there are.
"""

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.plans.shared import cut

# States of a key that one inner node of the tree merges, about, and keys that a task holds.
FAN_IN, HELD_KEYS = 32, 50_000


def merged_states(
    df: DataFrame,
    by: Sequence[str],
    update: Callable[[bytes | None, pd.DataFrame], bytes],
    merge: Callable[[bytes, bytes], bytes],
    finish: Callable[[bytes], Sequence[tuple]],
    schema: str,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """User-defined aggregate: rows (by..., fields of ``schema``) that ``finish`` makes of each key's state.

    ``update`` takes the state so far (None at first) and some rows of a key; ``merge`` must not
    mind the order. NULL keys are one key.
    """
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    names = list(by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, bytes] = {}

        def out() -> pd.DataFrame:
            # Keys go back as objects, so that a missing one does not turn whole numbers into floats.
            columns = {n: pd.Series([k[i] for k in held], dtype=object) for i, n in enumerate(names)}
            return pd.DataFrame({**columns, "_state": pd.Series(list(held.values()), dtype=object)})

        for b in batches:
            for key, rows in b.groupby(names, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                held[key] = update(held.get(key), rows)
            if len(held) > HELD_KEYS:
                yield out()
                held.clear()
        if held:
            yield out()

    def joined(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Any, bytes]]:
        """One state per run of equal keys (and slots)."""
        now, state = None, b""
        for b in rows:
            columns = [b[c].astype(object).where(b[c].notna(), None).tolist() for c in (*names, "_slot")]
            for *key, new in zip(*columns, b["_state"]):
                if key == now:
                    state = merge(state, bytes(new))
                else:
                    if now is not None:
                        yield tuple(now[:-1]), now[-1], state
                    now, state = key, bytes(new)
        if now is not None:
            yield tuple(now[:-1]), now[-1], state

    def inner(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, _, state in joined(rows):
            yield pd.DataFrame({**{n: pd.Series([k], dtype=object) for n, k in zip(names, key)}, "_state": pd.Series([state], dtype=object)})

    fields = [p.split()[0].strip("`") for p in schema.split(",")]

    def last(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, _, state in joined(rows):
            made = [(*key, *r) for r in finish(state)]
            if made:
                yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip([*names, *fields], zip(*made))})

    def sorted_by_key(states: DataFrame, slots: int) -> DataFrame:
        # A state's place in its task decides where it goes, so a repeated read deals the same.
        slot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)) if slots > 1 else F.lit(0)
        dealt = states.withColumn("_slot", slot.cast("long"))
        return dealt.repartition(*by, "_slot").sortWithinPartitions(*by, "_slot")

    # The partials are written once, so the salts of a repeated task are the same.
    states = cut(df.mapInPandas(partial, f"{keys}, _state binary"))
    while (most := states.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > fan_in:
        states = cut(sorted_by_key(states, -(-most // fan_in)).mapInPandas(inner, f"{keys}, _state binary"))
    return sorted_by_key(states, 1).mapInPandas(last, f"{keys}, {schema}")


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A Python class as a table function of SQL text, fed by Arrow batches: ``eval`` per row (a generator), ``terminate`` at the end of a partition.

    It stands in ``lateral name(columns)``, or takes ``table(t) partition by .. order by ..``: then
    the rows of a partition pass one at a time, and the object holds no more than it keeps itself.
    """
    spark.udtf.register(name, F.udtf(handler, returnType=returns, useArrow=True))
