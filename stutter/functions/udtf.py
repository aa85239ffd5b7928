"""SQL surface: ``LATERAL tandem_repeats(seq, k_list, min_repeat, miss, max_gap, policy)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import scan
from .scan import Rule

_RETURNS = "k int, motif string, cnt long, start_pos long, end_pos long"


class TandemRepeats:
    """Repeats of one string; long inputs belong in ``find_repeats``."""

    def __init__(self):
        self._rules = {}

    def eval(self, seq: str, k_list, min_repeat: int, miss: int, max_gap: int, policy: str):
        key = (tuple(k_list), min_repeat, miss, max_gap, policy)
        rule = self._rules.get(key)
        if rule is None:
            rule = self._rules[key] = Rule(key[0], min_repeat, miss, max_gap, policy=policy)
        if seq is None:
            return
        for k, p, cnt, end in scan.text_repeats(seq, rule):
            yield k, seq[p : p + k], cnt, p, end


def register(spark: SparkSession, name: str = "tandem_repeats") -> None:
    spark.udtf.register(name, udtf(TandemRepeats, returnType=_RETURNS))
