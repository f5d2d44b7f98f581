"""Function table: extents, parameters and facts on small hand-written sources."""

from __future__ import annotations

import random
import re

from graspmeter.operators import code_functions as fn

NESTED = """function outer(a) {
  function inner(b) {
    db.find(b);
  }
  return inner(a);
}
class Box {
  constructor(x) { this.x = x; }
  async load(id: string): Promise<void> {
    await api.get(id);
  }
}
export const run = async (q) => {
  return await client.send(q);
};
"""

TRIES = """function a() {
  try {
    try { db.find(1); } catch (inner) { throw inner; }
    db.find(2);
  } catch (outer) {
    console.error(outer);
  }
  try {
    db.find(3);
  } finally { done(); }
  try {
    db.find(4);
  } catch {
    skip();
  }
  try { db.find(5); } catch (last) { return 1; }
}
"""


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_nested_functions_methods_and_arrows(files):
    spans = fn.function_spans(files(n=NESTED))
    assert rows(spans, "start_line", "end_line", "name") == [
        (0, 5, "outer"), (1, 3, "inner"), (8, 10, "load"), (12, 14, "run"),
    ]


def test_call_in_nested_function_belongs_to_both(files):
    calls = fn.facts(fn.functions(files(n=NESTED)), "calls")
    assert rows(calls, "func_id", "line", "callee", "is_awaited") == [
        ("n.ts#0", 2, "db.find", False),
        ("n.ts#1", 2, "db.find", False),
        ("n.ts#12", 13, "client.send", True),
        ("n.ts#8", 9, "api.get", True),
    ]


def test_braces_in_strings_do_not_count(files):
    src = "function a() {\n  const s = '}' + \"{{\" + `}\\`}`;\n  return s;\n}\nfunction b() { return 2; }\n"
    spans = fn.function_spans(files(s=src))
    assert rows(spans, "name", "start_line", "end_line") == [("a", 0, 3), ("b", 4, 4)]


def test_quote_in_a_comment_opens_a_string_from_the_functions_start(files):
    # The apostrophe hides the closing brace of the first function, not those after it.
    src = "function a() {\n  // don't\n}\nfunction b() {\n  return 1;\n}\n"
    spans = fn.function_spans(files(s=src))
    assert rows(spans, "name", "start_line", "end_line") == [("b", 3, 5)]


def test_semicolon_before_a_brace_means_no_body(files):
    src = "declare function a(x): number;\nfunction b() { return 1; }\n"
    assert rows(fn.function_spans(files(s=src)), "name") == [("b",)]


def test_one_function_per_line_the_first_with_a_body(files):
    src = "const f = (a) => { return a; }; function g() { return 2; }\n"
    assert rows(fn.function_spans(files(s=src)), "name", "body") == [("f", " return a; ")]


def test_crlf_empty_file_and_file_without_functions(files):
    df = files(crlf="function a() {\r\n  return 1;\r\n}\r\n", empty="", plain="const x = 1;\n")
    spans = fn.function_spans(df)
    assert rows(spans, "file_id", "name", "end_line") == [("crlf.ts", "a", 2)]
    facts = fn.facts(fn.functions(df), "returns")
    assert rows(facts, "line", "expression") == [(1, "1")]


def test_multi_line_parameters_and_default_values(files):
    src = (
        "function a(\n  first: Map<string, number>,\n  second?: string,\n  third = [1, 2],\n  ...rest: any[]\n) {\n"
        "  return first;\n}\n"
    )
    params = fn.facts(fn.functions(files(s=src)), "parameters")
    assert rows(params, "pos", "name", "type", "has_default", "is_optional") == [
        (0, "first", "Map<string, number>", False, False),
        (1, "second", "string", False, True),
        (2, "third", None, True, True),
        (3, "rest", "any[]", False, False),
    ]


def test_destructured_parameter_is_kept_as_text(files):
    params = fn.facts(fn.functions(files(s="const f = ({ a, b }, c) => { return c; };\n")), "parameters")
    assert rows(params, "pos", "name") == [(0, "{ a, b }"), (1, "c")]


def test_try_blocks_nested_sequential_and_without_binding(files):
    blocks = fn.facts(fn.functions(files(t=TRIES)), "try_blocks")
    # The inner try is inside the first block. `finally` and `catch {` have no binding, so
    # the next `catch (x)` is theirs; the block after that is skipped past.
    assert rows(blocks, "try_start", "try_end", "catch_start", "catch_end", "catch_param", "only_logs", "has_return") == [
        (1, 4, 4, 6, "outer", True, False),
        (7, 9, 15, 15, "last", False, True),
    ]


def test_in_try_flag_includes_both_ends(files):
    calls = fn.facts(fn.functions(files(t=TRIES)), "calls")
    assert rows(calls, "line", "in_try") == [(2, True), (3, True), (8, True), (11, False), (15, False)]


def test_return_kinds_and_bare_return_twice(files):
    src = (
        "function r(x) {\n  if (x) return null;\n  if (x > 1) return undefined;\n  if (x > 2) return ;\n"
        "  if (x > 3) return await go();\n  if (x > 4) return new Promise(f);\n  return void 0;\n}\n"
    )
    returns = fn.facts(fn.functions(files(s=src)), "returns")
    assert rows(returns, "line", "kind") == [
        (1, "null"), (2, "undefined"), (3, "void"), (3, "void"), (4, "promise"), (5, "promise"), (6, "void"),
    ]


def test_throws_and_branches(files):
    src = (
        "function t(a) {\n  if (a && a.b || a.c) { throw new RangeError('x'); }\n  else if (a) { throw Error(1); }\n"
        "  switch (a) { default: throw custom; }\n  return a ? 1 : 2;\n}\n"
    )
    table = fn.functions(files(s=src))
    assert rows(fn.facts(table, "throws"), "line", "expression") == [(1, "new RangeError('x')"), (2, "Error(1)")]
    # if, if of else-if, else-if, switch, ?, ||, &&
    assert rows(table, "branch_count", "nesting_depth") == [(7, 1)]


def test_null_checks_of_parameters(files):
    src = (
        "function n(a, b, c, d, e, f) {\n  if (!a) return 1;\n  if (b === null) return 2;\n  const x = c ?? 0;\n"
        "  if (typeof d === 'undefined') return 3;\n  return e?.y + f.z;\n}\n"
    )
    checked = fn.functions(files(s=src)).select("null_checked").head()[0]
    assert sorted(checked) == ["a", "b", "c", "d", "e"]


def test_python_bodies_by_indent(files):
    src = "import x\n\nasync def a(p, q=1):\n    x = 1\n\n    return x\n\nclass C:\n    def m(self):\n        pass\n\ndef b():\n\treturn 2\n"
    table = fn.functions(files(m_py=src))
    assert rows(table, "name", "start_line", "end_line") == [("a", 2, 6), ("b", 11, 13)]
    # The body starts one line after its `def`, but is counted from the `def` line.
    assert rows(fn.facts(table, "returns"), "func_id", "line") == [("m_py.py#11", 11), ("m_py.py#2", 4)]


def test_many_candidates_reach_the_exact_fallback(files):
    # The outer body spans more pieces than the first two tries look at.
    inner = "".join(f"  if (x{i}) {{ f{i}(1); }}\n" for i in range(700))
    table = fn.function_spans(files(s=f"function big(a) {{\n{inner}}}\nfunction after() {{ return 1; }}\n"))
    assert rows(table, "name", "start_line", "end_line") == [("after", 702, 702), ("big", 0, 701)]


def test_result_does_not_depend_on_partitioning(files):
    df = files(n=NESTED, t=TRIES)
    base = rows(fn.functions(df), "func_id", "end_line", "branch_count")
    for n in (1, 4, 64):
        assert rows(fn.functions(df.repartition(n)), "func_id", "end_line", "branch_count") == base


def test_catch_part_that_is_never_closed_has_no_text(files):
    # Seen from the function's start the first quote is closed by the second one, so the
    # brace after it ends the function; seen from the catch part the second one opens.
    src = "function a() {\n  // it's\n  try { f(); } catch (e) { g('x); }\n}\n"
    table = fn.functions(files(s=src))
    assert rows(table, "name", "end_line") == [("a", 2)]
    assert rows(fn.facts(table, "try_blocks"), "catch_start", "catch_end", "catch_body") == [(2, 2, "")]


def test_very_long_call_chain_and_string(files):
    chain = "db" + ".a" * 30000
    src = f"function a() {{\n  {chain}(1);\n  const s = \"{'x{' * 200000}\";\n  return s;\n}}\n"
    table = fn.functions(files(s=src))
    assert rows(table, "end_line") == [(4,)]
    assert rows(fn.facts(table, "calls"), "line") == [(1,)]


def plain_spans(text):
    """Functions ``function f<n>(..)`` of a text by scanning characters from each one's start."""
    found = []
    for m in re.finditer(r"function (\w+)\(([^)]*)\)", text):
        quote, depth, done = "", 0, None
        opened = False
        for i in range(m.start(), len(text)):
            ch, before = text[i], text[i - 1] if i else ""
            if quote:
                if ch == quote and before != "\\":
                    quote = ""
            elif ch in "\"'`":
                quote = ch
            elif ch == ";" and not opened:
                break
            elif ch == "{":
                opened, depth = True, depth + 1
            elif ch == "}" and opened:
                depth -= 1
                if depth == 0:
                    done = i
                    break
        line = text.count("\n", 0, m.start())
        if done is not None and all(line != f[0] for f in found):
            found.append((line, text.count("\n", 0, done), m.group(1)))
    return sorted(found)


def test_extents_equal_a_plain_scan_on_random_texts(spark):
    rng = random.Random(11)
    parts = ["function f{n}(a)", "function g{n}('x{{')", "{", "}", "{", "}", "\n", "\n", ";", "'", '"', "`", "\\", " x ", "// it", "=> "]
    texts = []
    for _ in range(400):
        pieces = [rng.choice(parts).replace("{n}", str(i)).replace("{{", "{") for i in range(rng.randint(0, 60))]
        texts.append("".join(pieces))
    df = spark.createDataFrame(
        [(str(i), "x.ts", "x.ts", "typescript", "r", t) for i, t in enumerate(texts)],
        "file_id string, path string, relative_path string, language string, repo string, content string",
    )
    got: dict[str, list] = {}
    for r in fn.function_spans(df).where("name rlike '^[fg][0-9]+$'").collect():
        got.setdefault(r.file_id, []).append((r.start_line, r.end_line, r.name))
    for i, t in enumerate(texts):
        # Only declarations are generated, but one can also match as a method.
        names = {name for _, _, name in plain_spans(t)}
        assert [x for x in sorted(got.get(str(i), [])) if x[2] in names] == plain_spans(t), t
