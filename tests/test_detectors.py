"""Findings on the two sample sources and on cases the samples do not have."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from graspmeter.operators import code_functions as fn
from graspmeter.operators import detectors, paths, questions

TS = '''
export async function refundOrder(orderId, reason) {
  const receipt = await stripe.refund("order " + orderId, reason); const row = await db.find(orderId);
  return row;
}

const readConfig = (text) => {
  try {
    return JSON.parse(text);
  } catch (problem) {
    console.log(problem);
  }
};

function keepTokens() {
  const api_key = "abcd1234efgh"; const password = "abcd1234wxyz";
  return api_key;
}

class Store {
  async load(id) {
    const first = db.query(id); const second = fetch(id);
    function inner(name) {
      return name.length;
    }
    return inner(first) + second;
  }
}

function findOrders(name) {
  const sql = "SELECT id FROM orders WHERE buyer = '" + name + "'";
  return db.query(sql);
}
'''

PY = '''
def load_rows(key):
    rows = db.execute("SELECT a FROM b WHERE c = " + str(key))
    return rows

def guard(value):
    if value is None:
        return None
    return value.strip()

async def pull(address):
    answer = await http_client.get(address)
    return answer
'''

EXPECTED = {
    "refundOrder": ["HARDCODED_SECRET@15", "MISSING_ERROR_HANDLING@2", "UNHANDLED_ASYNC@2", "UNCHECKED_PARAMETER@2"],
    "readConfig": ["HARDCODED_SECRET@15", "SILENT_CATCH@9", "UNCHECKED_PARAMETER@8", "DEAD_CODE_AFTER_RETURN@9"],
    "keepTokens": ["HARDCODED_SECRET@15"],
    "load": ["HARDCODED_SECRET@15", "MISSING_ERROR_HANDLING@21", "MISSING_AWAIT@21", "UNCHECKED_PARAMETER@21"],
    "inner": ["HARDCODED_SECRET@15", "UNCHECKED_PARAMETER@23"],
    "findOrders": ["HARDCODED_SECRET@15", "MISSING_ERROR_HANDLING@31", "UNCHECKED_PARAMETER@30"],
    "load_rows": ["SQL_INJECTION_RISK@1", "MISSING_ERROR_HANDLING@1", "UNCHECKED_PARAMETER@1"],
    "guard": ["UNCHECKED_PARAMETER@7", "DEAD_CODE_AFTER_RETURN@7"],
    "pull": ["UNCHECKED_PARAMETER@10"],
}


@pytest.fixture(scope="module")
def samples(files):
    return files(a=TS, b_py=PY)


@pytest.fixture(scope="module")
def findings(samples):
    return detectors.detect_all(fn.functions(detectors.with_secrets(samples)))


def test_findings_of_the_samples_in_order(findings):
    got: dict[str, list[str]] = {}
    for r in findings.orderBy("func_id", "pos").collect():
        got.setdefault(r.func_name, []).append(f"{r.type}@{r.line}")
    assert got == EXPECTED


def test_counts_of_the_typescript_sample(findings):
    counted = questions.count_available(findings.where("file = 'a.ts'"))
    assert {(r.dimension, r.value): r.n for r in counted.collect()} == {
        ("total", "total"): 18,
        ("category", "error-handling"): 5, ("category", "edge-case"): 5, ("category", "security"): 6,
        ("category", "data-flow"): 1, ("category", "architecture"): 1,
        ("severity", "critical"): 6, ("severity", "high"): 6, ("severity", "medium"): 5, ("severity", "low"): 1,
    }


def test_every_question_is_well_formed(findings):
    bank = questions.render_questions(findings).collect()
    assert len(bank) == 48
    for q in bank:
        assert q.id and len(q.question) > 10 and len(q.explanation) > 5
        assert [o.label for o in q.options] == ["A", "B", "C", "D"]
        assert sum(o.is_correct for o in q.options) == 1
        assert 1 <= q.difficulty <= 5
        assert "{" not in q.question


def test_shuffle_depends_only_on_question_and_seed(findings):
    def order(df):
        return {r.id: [o.text for o in r.options] for r in df.collect()}

    first = order(questions.render_questions(findings, seed=1))
    assert order(questions.render_questions(findings.repartition(5), seed=1)) == first
    assert order(questions.render_questions(findings, seed=2)) != first


def test_local_questions_take_the_most_severe_first(findings):
    picked = questions.local_questions(findings, 10).collect()
    assert len(picked) == 10
    ranks = [["critical", "high", "medium", "low"].index(q.severity) for q in picked]
    assert ranks == sorted(ranks)


def test_shown_questions_come_back_only_when_nothing_is_fresh(spark, findings):
    keys = questions.question_keys(findings)
    ids = [r.id for r in keys.select("id").distinct().collect()]
    schema = "question_id string"
    some = spark.createDataFrame([(i,) for i in ids[:-1]], schema)
    left = questions.local_questions(findings, 10, shown=some).collect()
    assert {q.id for q in left} == {ids[-1]}
    everything = spark.createDataFrame([(i,) for i in ids], schema)
    assert len(questions.local_questions(findings, 10, shown=everything).collect()) == 10


def test_texts_are_filled_in(findings):
    row = detectors.describe(findings).where("type = 'UNHANDLED_ASYNC'").head()
    assert row.description == (
        'Awaited call `stripe.refund("order " + orderId, reason)` is not wrapped in a try-catch.'
    )
    assert row.correct_behavior.startswith("The await call on line 3 ")


def _types(files, src, name="s"):
    found = detectors.detect_all(fn.functions(detectors.with_secrets(files(**{name: src}))))
    return sorted((r.type, r.func_name, r.line) for r in found.collect())


def test_secret_is_reported_for_each_function_of_its_file(files):
    src = 'const token = "abcdefgh1234";\nfunction a() { x(); }\nfunction b() { y(); }\n'
    assert _types(files, src) == [("HARDCODED_SECRET", "a", 0), ("HARDCODED_SECRET", "b", 0)]
    assert detectors.file_secrets(files(s=src)).count() == 1
    assert _types(files, 'const token = "abcdefgh1234";\n') == []


def test_secret_kinds_and_previews(files):
    src = "\n".join(
        ["const password = 'hunter2hunter2';", "let k = 'sk-" + "a" * 24 + "';", "x = 'AKIA" + "B" * 16 + "'", "auth: \"zzzzzzzzzz\""]
    )
    got = sorted(tuple(r) for r in detectors.file_secrets(files(s=src)).select("line", "secret_type", "variable", "preview").collect())
    assert got == [
        (0, "password", "password", "hunt..."), (1, "api_key", "k", "sk-a..."), (2, "api_key", "unknown", "AKIA..."),
        (3, "token", "unknown", "zzzz..."),
    ]


def test_dead_code_skips_blank_and_comment_lines(files):
    src = "function a() {\n  return 1;\n\n  // note\n  left();\n}\nfunction b() {\n  throw e;\n}\n"
    assert _types(files, src) == [("DEAD_CODE_AFTER_RETURN", "a", 4)]


def test_missing_await_knows_where_the_result_is_used(files):
    src = "async function a() {\n  const r = axios.get(u);\n  log(1);\n  use(r.data);\n}\n"
    found = detectors.detect(fn.functions(detectors.with_secrets(files(s=src))), "MISSING_AWAIT").head()
    assert (found.line, found.evidence["result_used_on_line"], found.evidence["function_is_async"]) == (1, "3", "true")
    assert not [t for t in _types(files, src.replace("axios", "await axios")) if t[0] == "MISSING_AWAIT"]


def test_sql_with_template_literal_names_the_variable(files):
    src = "function a(id) {\n  return pool.query(`select ${id.x} from t`);\n}\n"
    found = detectors.detect(fn.functions(detectors.with_secrets(files(s=src))), "SQL_INJECTION_RISK").head()
    assert found.evidence["variable"] == "id.x"


def test_nearest_try_and_operation(files):
    src = (
        "function a() {\n  try {\n    db.find(1);\n  } catch (e) {\n    console.log(e);\n  }\n  db.find(2);\n"
        "  try {\n    x();\n  } catch (e) {\n    throw e;\n  }\n}\n"
    )
    table = fn.functions(detectors.with_secrets(files(s=src)))
    call = detectors.detect(table, "MISSING_ERROR_HANDLING").head()
    assert (call.line, call.evidence["nearest_try_catch"]) == (6, "7")
    silent = detectors.detect(table, "SILENT_CATCH").head()
    assert (silent.line, silent.end_line, silent.evidence["operation_in_try"]) == (3, 5, "db.find)")


def test_parameters_that_need_no_check(files):
    src = "function a(req, _, x = 1, y?: string) {\n  if (!req) return 2;\n  return x + y.z;\n}\n"
    assert not [t for t in _types(files, src) if t[0] == "UNCHECKED_PARAMETER"]


def test_code_paths_of_a_try_block(samples):
    got = paths.trace_paths(fn.functions(samples)).where("func_name = 'readConfig'").orderBy("path_no").collect()
    assert [(p.path_no, p.condition, p.return_value) for p in got] == [
        (0, "normal execution", "JSON.parse(text)"),
        (2, "if try block throws", "undefined (implicit) — error is swallowed after logging"),
    ]


def test_one_rule_gives_every_finding_of_a_line(samples):
    table = fn.functions(detectors.with_secrets(samples.where("file_id = 'a.ts'")))

    def found(rule, key, name):
        rows = detectors.detect(table, rule).where(F.col("func_name") == name).orderBy("pos").collect()
        return [(r.line, r.evidence[key]) for r in rows]

    assert found("MISSING_ERROR_HANDLING", "callee", "refundOrder") == [(2, "stripe.refund"), (2, "db.find")]
    assert found("UNCHECKED_PARAMETER", "parameter", "refundOrder") == [(2, "orderId"), (2, "reason")]
    assert found("MISSING_AWAIT", "async_call", "load") == [(21, "db.query"), (21, "fetch")]
    assert found("MISSING_AWAIT", "result_used_on_line", "load") == [(21, "25"), (21, "25")]
    assert found("HARDCODED_SECRET", "partial_value", "keepTokens") == [(15, "abcd..."), (15, "abcd...")]
    assert detectors.file_secrets(samples).count() == 2


def test_missing_await_on_a_long_function_is_linear(files):
    def seconds(n):
        plain = "".join(f"  const v{i} = plain{i}(x);\n" for i in range(n))
        calls = "".join(f"  const w{i} = db.query(v{i});\n  use(w{i});\n" for i in range(n // 10))
        table = fn.functions(detectors.with_secrets(files(s="async function big(x) {\n" + plain + calls + "}\n")))
        start = time.perf_counter()
        rows = detectors.detect(table, "MISSING_AWAIT").collect()
        taken = time.perf_counter() - start
        assert len(rows) == n // 10
        # The name stands again on the next line.
        assert all(int(r.evidence["result_used_on_line"]) == r.line + 2 - 1 for r in rows)
        return taken

    seconds(100)
    assert seconds(3000) < 3 * seconds(1500) + 1


def test_uncaught_throw_is_named(files):
    src = "function a() {\n  throw new NotFoundError('x');\n}\n"
    path = paths.trace_paths(fn.functions(files(s=src))).head()
    assert (path.can_throw, path.throws_what) == (True, "NotFoundError")


def test_first_per_rule_keeps_the_first_function(files):
    src = "function a(p) { return p.x; }\nclass C {\n  a(q) { return q.y; }\n}\n"
    found = detectors.detect(fn.functions(detectors.with_secrets(files(s=src))), "UNCHECKED_PARAMETER")
    assert found.count() == 2
    assert questions.first_per_rule(found).select(F.col("line")).collect() == [(0,)]
