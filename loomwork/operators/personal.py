"""Personal data in texts as spans: found by kind, proven by check digits, united where they overlap, masked once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each kind looks like. Word bounds are those of ASCII.
KINDS = {
    "phone_number_ru": r"(?:\+7|\b8)[ (-]*[0-9]{3}[ )-]*[0-9]{3}[ -]*[0-9]{2}[ -]*[0-9]{2}\b",
    "passport_ru": r"\b[0-9]{2}[ ]+[0-9]{2}[ ]+[0-9]{6}\b",
    "inn_ru": r"\b(?:[0-9]{10}|[0-9]{12})\b",
    "snils_ru": r"\b[0-9]{3}-?[0-9]{3}-?[0-9]{3} ?[0-9]{2}\b",
    "oms_ru": r"\b[0-9]{16}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
#: Weights of the check digits of taxpayer numbers of ten and of twelve digits.
INN_10, INN_11, INN_12 = [2, 4, 10, 3, 5, 9, 4, 6, 8], [7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
ANY = "russian_pii"
_COMPILED = {kind: re.compile(p, re.ASCII) for kind, p in KINDS.items()}

Span = tuple[int, int, str]


def _digit(digits: str, weights: list[int]) -> str:
    return str(sum(int(d) * w for d, w in zip(digits, weights, strict=False)) % 11 % 10)


def inn_is_right(digits: str) -> bool:
    if len(digits) == 10:
        return digits[9] == _digit(digits, INN_10)
    return len(digits) == 12 and digits[10:] == _digit(digits, INN_11) + _digit(digits, INN_12)


def snils_is_right(digits: str) -> bool:
    return len(digits) == 11 and int(digits[9:]) == sum(int(d) * (9 - i) for i, d in enumerate(digits[:9])) % 101 % 100


_CHECKS = {"inn_ru": inn_is_right, "snils_ru": snils_is_right}


def spans(text: str) -> Iterator[Span]:
    """(start, end, kind) of what is found, kind by kind; numbers with wrong check digits are none."""
    for kind, pattern in _COMPILED.items():
        check = _CHECKS.get(kind)
        for m in pattern.finditer(text):
            if check is None or check(re.sub("[^0-9]", "", m[0])):
                yield m.start(), m.end(), kind


def united(found: list[Span]) -> list[Span]:
    """Spans in order, those that overlap or touch as one, of the kind that starts first and is longest."""
    out: list[Span] = []
    for start, end, kind in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def mask(text: str, found: list[Span], sign: str = "***") -> str:
    """text with each united span replaced once."""
    parts, at = [], 0
    for start, end, _ in united(found):
        parts += [text[at:start], sign]
        at = end
    return "".join([*parts, text[at:]])


def personal_data(df: DataFrame, key: str, text: str, sign: str = "***") -> DataFrame:
    """(key, spans, masked) of each text, in one scan. spans has structs of start, end (code points) and kind, by place, before they are united;
    masked is the text with what they cover replaced once. A null text has no spans and stays null; other columns are not read."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part[text].to_pylist()
                found = [sorted(spans(t)) if t else [] for t in texts]
                masked = [t and mask(t, f, sign) for t, f in zip(texts, found, strict=True)]
                structs = [[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found]
                yield pa.RecordBatch.from_arrays([part[key], pa.array(structs, span), pa.array(masked, pa.string())], [key, "spans", "masked"])

    rows = df.select(key, F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, spans array<struct<start:int,end:int,kind:string>>, masked string")


def reasons(spans: Column) -> Column:
    """The kinds found, in order of KINDS; after kinds of Russian data one name for any of them."""
    kinds = F.transform(spans, lambda s: s["kind"])
    own = F.filter(F.array(*map(F.lit, KINDS)), lambda k: F.array_contains(kinds, k))
    return F.when(F.exists(own, lambda k: k.endswith("_ru")), F.concat(own, F.array(F.lit(ANY)))).otherwise(own)


def gate(rows: DataFrame, stage: str, blocked: list[str]) -> DataFrame:
    """rows of personal_data with verdict and tripwires: block if a reason is in blocked, mask if there is another one, else pass. tripwires name stage and reason."""
    found = reasons(F.col("spans"))
    trips = F.transform(found, lambda r: F.concat(F.lit(f"{stage}:"), r))
    verdict = F.when(F.arrays_overlap(found, F.array(*map(F.lit, blocked)) if blocked else F.array().cast("array<string>")), "block").when(F.size("spans") > 0, "mask").otherwise("pass")
    return rows.withColumn("verdict", verdict).withColumn("tripwires", trips)
