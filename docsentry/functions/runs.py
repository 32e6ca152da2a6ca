"""Small ordered computations on numbers: longest increasing runs, and earliest free choices.

Pickled by value, so that executors need no copy of the package.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def longest_increasing(numbers: Iterable[int]) -> list[int]:
    """Indices of a longest increasing run of different numbers, by patience piles.

    The run ends with the number placed last on the last pile; before each
    number comes the one that lay on top of the pile before when it was placed.
    """
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, number in enumerate(numbers):
        pile = bisect_left(tops, number)
        tops[pile : pile + 1], at[pile : pile + 1] = [number], [i]
        before.append(at[pile - 1] if pile else -1)
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def longest_increasing_run(numbers: Column) -> Column:
    """Indices of a longest increasing run of an int array; null for null."""

    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda x: None if x is None else longest_increasing(x.tolist()))

    return F.pandas_udf(run, ArrayType(IntegerType()))(numbers)


def earliest_free(key: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Function for a cogroup of askers (key, actual_no, class) and wishes (key, kind, expected_no, class), with all rows of its cases.

    A wish row without class is an expectation of its kind, one without
    expected_no says that the class takes the kind. Askers in order take the
    smallest free expectation of their kinds: one queue a kind, and only its
    head is ever looked at.
    """

    def take(askers: pd.DataFrame, wishes: pd.DataFrame) -> pd.DataFrame:
        is_offer = wishes["class"].isna()
        queues: dict[tuple, list[int]] = defaultdict(list)
        for case, kind, number in wishes.loc[is_offer, [key, "kind", "expected_no"]].itertuples(index=False):
            queues[case, kind].append(number)
        for queue in queues.values():
            queue.sort(reverse=True)
        taken_by: dict[tuple, list[list[int]]] = defaultdict(list)
        for case, name, kind in wishes.loc[~is_offer, [key, "class", "kind"]].itertuples(index=False):
            if (case, kind) in queues:
                taken_by[case, name].append(queues[case, kind])
        out = []
        order = askers.sort_values("actual_no", kind="stable")
        for case, number, name in zip(order[key].tolist(), order["actual_no"].tolist(), order["class"].tolist(), strict=True):
            heads = [queue for queue in taken_by.get((case, name), ()) if queue]
            if heads:
                out.append((case, number, int(min(heads, key=lambda q: q[-1]).pop())))
        found = pd.DataFrame(out, columns=[key, "actual_no", "expected_no"])
        return found.astype({"actual_no": "int64", "expected_no": "int64"})

    return take
