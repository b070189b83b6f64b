"""How rules do on statements that an accountant has labelled: labels, agreement, coverage and what is left."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prefixes by which a rule says what it is compared with; all others look at purpose and counterparty.
ACCOUNT_PREFIX, PURPOSE_PREFIXES = "rachunek kontrahenta", ("tytuł", "tytul")
FIELDS = ("account", "purpose", "both", "counterparty")
JOINT = " || "


@dataclass(frozen=True)
class LabelRule:
    """One line of the accountant's file, with what normal forms make of its texts: ``purpose`` holds if all its parts are found."""

    purpose: str = ""
    counterparty: str = ""
    direction: str = ""
    code: str | None = None
    field: str = "both"

    @classmethod
    def of(cls, spelled: str, normal: str, **rest) -> LabelRule:
        """A rule whose purpose was spelled so and has that normal form; the spelling's prefix names the field."""
        low = spelled.lower()
        named = "account" if low.startswith(ACCOUNT_PREFIX) else "purpose" if low.startswith(PURPOSE_PREFIXES) else "both"
        return cls(purpose=normal, field=named, **rest)

    def parts(self) -> set[tuple[str, str]]:
        """(field, text) that must all be found."""
        said = {(self.field, p.strip()) for p in self.purpose.split(";") if p.strip()}
        return said | ({("counterparty", self.counterparty)} if self.counterparty else set())


#: Texts of a kind, and sets of found parts, whose outcome a task remembers.
MEMO = 1 << 16


class LabelIndex:
    """Rules in the order of their file, found by their texts: one automaton a text gives all parts that a row holds in one pass.

    What a text holds is a number with a bit a part, and is remembered, as texts
    come again in many rows. Parts have no blank at their ends, so in purpose and
    counterparty together only those with a bar of ``JOINT`` can lie across both.
    """

    def __init__(self, rules: Iterable[LabelRule]):
        self.rules = list(rules)
        parts = [r.parts() for r in self.rules]
        self.needs = [len(p) for p in parts]
        self.free = [k for k, n in enumerate(self.needs) if not n]
        self.bits = {part: n for n, part in enumerate(sorted(set().union(*parts)))}
        self.of_bit: list[list[int]] = [[] for _ in self.bits]
        for k, p in enumerate(parts):
            for part in p:
                self.of_bit[self.bits[part]].append(k)
        bar = JOINT.strip()[0]
        whole = lambda part: part[0] == "both" and bar in part[1]
        self._purpose, self._counterparty, self._account = (
            lru_cache(MEMO)(self._finder(lambda part, fields=fields: part[0] in fields and not whole(part))) for fields in (("purpose", "both"), ("counterparty", "both"), ("account",))
        )
        self._joint = self._finder(whole) if any(map(whole, self.bits)) else None
        self._fits = lru_cache(MEMO)(self._first_of)

    def _finder(self, wanted: Callable[[tuple[str, str]], bool]) -> Callable[[str], int]:
        """A function that gives the parts among those wanted that a text holds."""
        masks: dict[str, int] = defaultdict(int)
        for part, n in self.bits.items():
            if wanted(part):
                masks[part[1]] |= 1 << n
        if not masks:
            return lambda text: 0
        found = ahocorasick.Automaton()
        for text, mask in masks.items():
            found.add_word(text, mask)
        found.make_automaton()

        def held(text: str) -> int:
            out = 0
            for _, mask in found.iter(text):
                out |= mask
            return out

        return held

    def _first_of(self, held: int, direction: str) -> int:
        met: dict[int, int] = defaultdict(int)
        while held:
            n = held.bit_length() - 1
            held ^= 1 << n
            for k in self.of_bit[n]:
                met[k] += 1
        fits = (k for k in (*self.free, *(k for k, n in met.items() if n == self.needs[k])) if self.rules[k].direction in ("", direction))
        return min(fits, default=-1)

    def first(self, purpose: str, counterparty: str, account: str, direction: str) -> int:
        """The first rule that fits, by its place; -1 if none does. Texts are in their normal form."""
        held = self._purpose(purpose) | self._counterparty(counterparty) | self._account(account)
        if self._joint:
            held |= self._joint(purpose + JOINT + counterparty)
        return self._fits(held, direction)


def label_rows(rows: DataFrame, rules: dict[str, list[LabelRule]], country: str = "country") -> DataFrame:
    """``rows`` with ``label_rule``, the place of the country's first rule that fits, and ``label``, its code.

    rows: purpose_norm, counterparty_norm, account_norm and direction. The first
    rule decides, even one without a code: such rows have no label. Null texts
    count as empty. Rules are an accountant's file, so they travel with the task.
    """
    indexes: dict[str, LabelIndex] = {}

    @F.pandas_udf("struct<label_rule:int,label:string>")
    def labelled(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for where, *texts in columns:
            out = []
            for place, *row in zip(where, *texts, strict=True):
                if place not in indexes:
                    indexes[place] = LabelIndex(rules.get(place, []))
                k = indexes[place].first(*[x or "" for x in row])
                out.append((k, indexes[place].rules[k].code) if k >= 0 else (None, None))
            yield pd.DataFrame(out, columns=["label_rule", "label"]).astype({"label_rule": "Int32"})

    found = rows.withColumn("__l", labelled(country, "purpose_norm", "counterparty_norm", "account_norm", "direction"))
    return found.select("*", F.col("__l.label_rule").alias("label_rule"), F.col("__l.label").alias("label")).drop("__l")


def verdict(predicted: Column, label: Column, needs_allocation: Iterable[str] = (), others: Iterable[str] = ()) -> Column:
    """agreed, awaiting_allocation, less_specific or disagreed; unlabelled without a label, uncovered without a prediction.

    Less specific is a prediction above the label. A category named Other below
    its section (``others``) counts as the section itself.
    """
    needs_allocation, others = list(needs_allocation), list(others)
    bare = F.when(predicted.isin(others), F.left(predicted, F.length(predicted) - 2)).otherwise(predicted) if others else predicted
    above = F.startswith(label, bare) & (F.length(bare) < F.length(label))
    waits = predicted.isin(needs_allocation) if needs_allocation else F.lit(False)
    return F.when(predicted.isNull(), "uncovered").when(label.isNull(), "unlabelled").when(predicted == label, "agreed").when(waits, "awaiting_allocation").when(above, "less_specific").otherwise("disagreed")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part * F.lit(100.0) / whole)


def coverage(rows: DataFrame, by: list[str], amount: str, key: str) -> DataFrame:
    """Of each group: rows and amount covered, the verdicts, their percentages, and how many counterparties are left.

    rows: ``by``, verdict, the amount (its size counts) and the counterparty's
    key. Percentages of accuracy are of the rows that were judged; a percentage
    of nothing is null. One aggregation by (group, key) and one by group, so a
    counterparty that holds a third of all rows is one partial sum a task.
    """
    verdicts = ("agreed", "awaiting_allocation", "less_specific", "disagreed", "unlabelled", "uncovered")
    size = F.abs(F.col(amount))
    keyed = rows.groupBy(*by, key).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts], F.sum(size).alias("volume"), F.sum(F.when(F.col("verdict") != "uncovered", size)).alias("covered"))
    sums = keyed.groupBy(*by).agg(*[F.sum(v).alias(v) for v in verdicts], F.sum("volume").alias("volume_minor"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered_minor"), F.count_if(F.col("uncovered") > 0).alias("residue_keys"))
    seen = sum((F.col(v) for v in verdicts[1:]), F.col(verdicts[0]))
    judged = sum((F.col(v) for v in verdicts[1:4]), F.col(verdicts[0]))
    return sums.select(
        *by,
        seen.alias("row_count"),
        (seen - F.col("uncovered")).alias("matched"),
        *verdicts,
        "residue_keys",
        "covered_minor",
        "volume_minor",
        _percent(seen - F.col("uncovered"), seen).alias("rows_pct"),
        _percent(F.col("covered_minor"), F.col("volume_minor")).alias("amount_pct"),
        _percent(F.col("agreed"), judged).alias("agreed_pct"),
        _percent(F.col("disagreed"), judged).alias("disagreed_pct"),
    )


def residue(rows: DataFrame, by: list[str], name: Column, most: int = 4, letters: int = 52) -> DataFrame:
    """Of each group the names that most uncovered rows have: by, name, row_count, rank; ties go by name."""
    counts = rows.where("verdict = 'uncovered'").groupBy(*by, F.left(F.coalesce(name, F.lit("")), F.lit(letters)).alias("name")).agg(F.count(F.lit(1)).alias("row_count"))
    return top_of(counts, by, [F.desc("row_count"), F.col("name")], most)


def top_of(totals: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their ``rank``.

    The limit on the rank lets every task keep its own first ``most`` of a group
    before anything is sent, so no task sees a whole group.
    """
    return totals.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
