"""Merge patches by the examples of their standard, and rows that are no JSON."""

import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import jsons as J

#: The standard's own examples (target, patch, result).
CASES = [
    ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"), ('{"a":"b","b":"c"}', '{"a":null}', '{"b":"c"}'), ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"c"}', '{"a":["b"]}', '{"a":["b"]}'),
    ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'), ('{"a":[{"b":"c"}]}', '{"a":[1]}', '{"a":[1]}'), ('["a","b"]', '["c","d"]', '["c","d"]'), ('{"a":"b"}', '["c"]', '["c"]'), ('{"a":"foo"}', "null", "null"), ('{"a":"foo"}', '"bar"', '"bar"'),
    ('{"e":null}', '{"a":1}', '{"e":null,"a":1}'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'),
]


@pytest.mark.parametrize("target, patch, result", CASES)
def test_examples(target, patch, result):
    assert J.merged(json.loads(target), json.loads(patch)) == json.loads(result)


def test_rows(spark):
    rows = [*CASES, (None, '{"a":1}', '{"a":1}'), ('{"a":1}', None, '{"a":1}'), (None, None, None), ("{broken", "{}", None), ("{}", "oops", None), ('{"ü":"日"}', '{"n":12345678901234567890}', '{"ü":"日","n":12345678901234567890}'), ("{}", "[" * 50 + "]" * 50, "[" * 50 + "]" * 50)]
    df = spark.createDataFrame(rows, "t string, p string, want string")
    assert df.where(~J.merge_patch(F.col("t"), F.col("p")).eqNullSafe(F.col("want"))).count() == 0


def test_blanks_are_skipped(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}', '{"a":null,"b":" ","c":"y","d":0,"e":{}}'), (None, '{"a":""}'), ("[1]", '{"a":1}')], "t string, v string")
    assert [r[0] for r in df.select(J.merge_filled(F.col("t"), F.col("v"))).collect()] == ['{"a":1,"b":"x","c":"y","d":0,"e":{}}', "{}", '{"a":1}']


def test_array_sizes(spark):
    df = spark.createDataFrame([('{"a":[1,[2,3],{}]}',), ('{"a":{"b":1}}',), ('{"a":"[1]x"}',), ("{}",), (None,), ('{"a":[]}',)], "j string")
    assert [r[0] for r in df.select(J.array_size(F.col("j"), "$.a")).collect()] == [3, None, None, None, None, 0]
