"""Braces by blocks against a plain lexer, and against the functions that are found in one piece."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from graspmeter.functions.text import running_sums
from graspmeter.operators import code_functions as fn
from graspmeter.operators import lexing
from graspmeter.operators.lexing import brace_pairs, code_marks, function_extents


def brute_pairs(text):
    """Character by character: a quote ends at the next same one that has no backslash before it."""
    stack_by_level, depth, line, quote, pairs = {}, 0, 0, "", []
    for at, c in enumerate(text):
        if quote:
            if c == quote and text[at - 1] != "\\":
                quote = ""
        elif c in "\"'`":
            # A quote without an end swallows the rest.
            quote = c
        elif c == "{":
            depth += 1
            stack_by_level[depth] = (at, line)
        elif c == "}":
            if depth in stack_by_level:
                begin, first = stack_by_level.pop(depth)
                pairs.append((begin, at, depth, first, line))
            depth -= 1
        line += c == "\n"
    return sorted(pairs)


@pytest.mark.parametrize(("size", "run"), [(1, 2), (7, 3), (64, 512), (1 << 15, 512)])
def test_blocks_equal_a_plain_lexer(files, size, run):
    pick = random.Random(size)
    texts = {f"t{i}": "".join(pick.choice("{}{};\"'`\\ \nab🙂") for _ in range(pick.randrange(300))) for i in range(60)}
    texts |= {"none": "a; b", "empty": "", "open": "{" * 40, "closed": "}" * 40 + "{}", "slashes": "{" + "\\" * 50 + "\"{\\\"}\"}", "quote": "{'\n{}"}
    got = {}
    for r in brace_pairs(files(**texts), size, run).collect():
        got.setdefault(r.file_id, []).append((r.open_at, r.close_at, r.level, r.open_line, r.close_line))
    for name, text in texts.items():
        assert sorted(got.get(f"{name}.ts", [])) == brute_pairs(text), repr(text)


def test_a_text_is_cut_at_braces_and_semicolons_only(spark):
    """Offsets are summed up over the pieces of a block, so words, strings and what an open quote swallows are none."""
    pick = random.Random(3)
    texts = ["".join(pick.choice("{};\"'`\\ \nab") for _ in range(pick.randrange(80))) for _ in range(300)] + ["", "a 'b' " * 50 + "{", "{\"};"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    place = lexing._place(F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    pieces = F.size(F.regexp_extract_all("text", F.lit(lexing._TOKEN), F.lit(0)))
    for text, n, marks in frame.select("text", pieces, lexing._listed(F.col("text"), place)).collect():
        want, quote = [], ""
        for at, c in enumerate(text):
            if quote:
                quote = "" if c == quote and text[at - 1] != "\\" else quote
            elif c in "\"'`":
                quote = c
            elif c in "{};":
                want.append((c, at))
        assert [(m.kind, m.at) for m in marks] == want and n == len(want), repr(text)


def test_null_and_no_contents(spark, files):
    frame = files(a="{}").withColumn("content", F.when(F.lit(False), F.col("content")))
    assert brace_pairs(frame).count() == 0 and brace_pairs(files(a="{}").limit(0)).count() == 0


SOURCE = """
import x from "y";
export async function first(a, b = "}") {
  if (a) { return `{${a}`; }
  return b;
}
const second = (p) => { call('it\\'s {'); };
class C {
  method(x) {
    return x;
  }
  other() { return 1 }
}
const lost = (q) => q + 1
const third = async (r) =>
{
  return r;
};
declare function none(a): void;
"""


def test_extents_equal_the_functions_found_in_one_piece(files):
    texts = {f"f{i}": SOURCE * i for i in range(1, 4)} | {"g_py": "def f():\n    return {}\n"}
    frame = files(**texts)
    want = fn.function_spans(frame).where("language <> 'python'").select("file_id", "name", "start_line", "end_line", "body")
    for size in (16, 1 << 15):
        found = function_extents(frame, size)
        body = F.expr("substring(content, open_at + 2, close_at - open_at - 1)").alias("body")
        got = found.join(frame.select("file_id", "content"), "file_id").select("file_id", "name", "start_line", "end_line", body)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 20


def test_long_files_take_many_tasks_and_linear_time(files):
    """Arrow functions without semicolons: each candidate used to look at all of the rest."""

    def text(n):
        return "".join(f"const a{i} = (x) => x + {i}\n" for i in range(n)) + "{}"

    took = []
    for n in (10_000, 40_000):
        frame = files(long=text(n))
        start = time.perf_counter()
        # All candidates reach the last braces, so all have that body.
        assert function_extents(frame).agg(F.count("*"), F.countDistinct("open_at")).first() == (n, 1)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 5
    marks = code_marks(files(long="{ a; }\n" * 100_000))
    assert marks.select("block").distinct().count() > 20 and marks.count() == 300_000


def test_running_sums(spark):
    for n in (0, 1, 511, 512, 513, 3000):
        got = spark.range(1).select(running_sums(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (i % 7).cast("int"))).alias("s")).head().s
        total, want = 0, []
        for i in range(n + 1):
            total += i % 7
            want.append(total)
        assert got == want
    assert spark.range(1).select(running_sums(F.array().cast("array<int>")).alias("s")).head().s == []
