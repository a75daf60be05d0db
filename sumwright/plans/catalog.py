"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwright.functions import cleaning, packing, prompts, quality, shapes, similarity
from sumwright.functions.execute import eval_program, screen_steps
from sumwright.functions.numbers import round_exact, row_to_nums, str_to_num
from sumwright.functions.program_text import (
    dropped_steps,
    linearize_program,
    linearize_tokens,
    parse_raw_to_steps,
    steps_to_tokens,
    structure_ok,
    tokenize_program,
    tokens_to_steps,
    verify_tokens,
)
from sumwright.functions.text import WHITESPACE, words
from sumwright.operators import corpus, decode, evaluate, long_texts, retrieve, sample, subwords, text_vectors, tokens
from sumwright.operators.partition import spread
from sumwright.operators.run_programs import with_equality, with_result
from sumwright.plans import derive as d
from sumwright.plans import workflows
from sumwright.plans.derive import fill, row_id, table
from sumwright.session import checkpointed
from sumwright.sources.corpora import best_run
from sumwright.sources.examples import linear_program, program_text, tensor_columns, typed_examples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL fragments for the columns of ``derive``.
SQL_P = "CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)"
SQL_Q = "CAST(CAST(l_quantity AS DECIMAL(15,2)) AS VARCHAR)"
SQL_D = "CAST(CAST(l_discount AS DECIMAL(15,2)) AS VARCHAR)"
SQL_ID = f"concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {SQL_P})"
# A user turn and the assistant turn that comes next.
SQL_PAIRS = """pairs AS (
  SELECT conv_id, turn, question, answer, substr(question, 1, 100) AS source FROM (
    SELECT conv_id, turn, role, text AS question,
           lead(role) OVER w AS next_role, lead(text) OVER w AS answer
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def r5(expression: str) -> str:
    """SQL that rounds the exact binary value to five decimals."""
    return f"CAST(printf('%.5f', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[\\s\\x0b\\x{{85}}\\x{{a0}}]+'), lambda w: w <> '')"


def sql_variant(count: int) -> str:
    return f"((l_orderkey + l_linenumber) % {count})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _run(spark: SparkSession, folder: str, program: Column, grid: Column | None = None) -> DataFrame:
    rows = d.lines(spark, folder).select(
        row_id().alias("id"),
        tokenize_program(program).alias("predicted"),
        *([] if grid is None else [grid.alias("grid")]),
    )
    done = with_result(rows, "predicted", None if grid is None else "grid")
    return done.select("id", "result.invalid", "result.num", "result.txt")


# Execution of programs


@query(
    "exec_long",
    f"""SELECT {SQL_ID} AS id, CAST(0 AS INTEGER) AS invalid,
        {r5("(((l_extendedprice - l_quantity) / l_quantity * 2 + 1) - l_extendedprice) / l_quantity")} AS num,
        CAST(NULL AS VARCHAR) AS txt FROM lineitem""",
)
def exec_long(spark: SparkSession, folder: str) -> DataFrame:
    steps = "subtract({P}, {Q}), divide(#0, {Q}), multiply(#1, 2), add(#2, 1), subtract(#3, {P}), divide(#4, {Q})"
    return _run(spark, folder, fill(steps))


@query(
    "exec_both_ways",
    f"""SELECT {SQL_ID} AS id, {r5("(l_extendedprice - l_quantity) / l_quantity * l_discount")} AS compiled,
        {r5("(l_extendedprice - l_quantity) / l_quantity * l_discount")} AS folded FROM lineitem""",
)
def exec_both_ways(spark: SparkSession, folder: str) -> DataFrame:
    """The same programs laid out as columns and folded over their steps."""
    program = tokenize_program(fill("subtract({P}, {Q}), divide(#0, {Q}), multiply(#1, {D})"))
    rows = d.lines(spark, folder).select(row_id().alias("id"), program.alias("predicted"))
    done = with_result(rows, "predicted").withColumn("fold", eval_program(F.col("predicted")))
    return done.select("id", F.col("result.num").alias("compiled"), F.col("fold.num").alias("folded"))


@query(
    "round_large",
    f"""SELECT {SQL_ID} AS id, CAST(printf('%.5f', x) AS DOUBLE) AS rounded
        FROM (SELECT *, l_extendedprice * 1000000.0 + l_orderkey * 0.000225 AS x FROM lineitem)""",
)
def round_large(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers up to about 1e11 with many decimals."""
    value = round_exact(F.col("l_extendedprice") * 1000000.0 + F.col("l_orderkey") * 0.000225)
    return d.lines(spark, folder).select(row_id().alias("id"), value.alias("rounded"))


@query(
    "exec_arith",
    f"""SELECT {SQL_ID} AS id, CAST(0 AS INTEGER) AS invalid,
        {r5("(l_extendedprice - l_quantity) / l_extendedprice * 1.5")} AS num,
        CAST(NULL AS VARCHAR) AS txt FROM lineitem""",
)
def exec_arith(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, fill("subtract({P}, {Q}), divide(#0, {P}), multiply(#1, 1.5)"))


@query(
    "exec_greater",
    f"""SELECT {SQL_ID} AS id, CAST(0 AS INTEGER) AS invalid, CAST(NULL AS DOUBLE) AS num,
        CASE WHEN l_extendedprice - 50000 > l_quantity * 100 THEN 'yes' ELSE 'no' END AS txt
        FROM lineitem""",
)
def exec_greater(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, fill("subtract({P}, 50000), multiply({Q}, const_100), greater(#0, #1)"))


@query(
    "exec_power",
    f"""SELECT {SQL_ID} AS id, CAST(0 AS INTEGER) AS invalid,
        {r5("pow(l_quantity, 1.5) / l_extendedprice")} AS num, CAST(NULL AS VARCHAR) AS txt
        FROM lineitem""",
)
def exec_power(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, fill("exp({Q}, 1.5), divide(#0, {P})"))


@query(
    "exec_invalid",
    f"""SELECT id, CAST(num IS NULL AS INTEGER) AS invalid, num, CAST(NULL AS VARCHAR) AS txt
        FROM (SELECT {SQL_ID} AS id, CASE {sql_variant(7)}
          WHEN 0 THEN CASE WHEN l_tax <> 0 THEN {r5("l_extendedprice / nullif(l_tax, 0)")} END
          WHEN 6 THEN {r5("l_extendedprice + l_quantity")} END AS num FROM lineitem)""",
)
def exec_invalid(spark: SparkSession, folder: str) -> DataFrame:
    program = d.choose(d.variant(7), *map(fill, d.BROKEN_VARIANTS))
    return _run(spark, folder, program)


@query(
    "exec_table_agg",
    f"""SELECT id, 0::INTEGER AS invalid, {r5("v / l_quantity")} AS num,
        CAST(NULL AS VARCHAR) AS txt
        FROM (SELECT {SQL_ID} AS id, l_quantity, CASE {sql_variant(4)}
          WHEN 0 THEN greatest(l_extendedprice, l_quantity, round(l_discount * 100) / 100.0)
          WHEN 1 THEN least(l_extendedprice, l_quantity, round(l_discount * 100) / 100.0)
          WHEN 2 THEN l_extendedprice + l_quantity + round(l_discount * 100) / 100.0
          ELSE (l_extendedprice + l_quantity + round(l_discount * 100) / 100.0) / 3 END AS v
        FROM lineitem)""",
)
def exec_table_agg(spark: SparkSession, folder: str) -> DataFrame:
    names = ("table_max", "table_min", "table_sum", "table_average")
    options = [fill(f"{n}(amounts, none), divide(#0, {{Q}})") for n in names]
    return _run(spark, folder, d.choose(d.variant(4), *options), d.price_table())


@query(
    "screen_exec",
    f"""SELECT {SQL_ID} AS id, CASE {sql_variant(4)}
          WHEN 0 THEN CASE WHEN l_tax <> 0 THEN round(l_extendedprice / nullif(l_tax, 0), 6) END
          WHEN 1 THEN CAST(l_extendedprice > l_quantity * 1000 AS DOUBLE)
          WHEN 2 THEN NULL
          ELSE round(l_quantity - 7, 6) END AS value FROM lineitem""",
)
def screen_exec(spark: SparkSession, folder: str) -> DataFrame:
    program = d.choose(
        d.variant(4),
        fill("divide({P}, {X})"),
        fill("multiply({Q}, 1000), greater({P}, #0)"),
        fill("table_max(amounts, none)"),
        fill("subtract({Q}, const_7)"),
    )
    value = screen_steps(tokens_to_steps(tokenize_program(program)))
    return d.lines(spark, folder).select(row_id().alias("id"), F.round(value, 6).alias("value"))


# Program text


@query(
    "str_to_num",
    f"""SELECT {SQL_ID} AS id, CASE {sql_variant(5)}
          WHEN 0 THEN l_extendedprice WHEN 1 THEN round(l_discount * 100) / 100.0
          WHEN 2 THEN CAST(l_linenumber AS DOUBLE) WHEN 3 THEN -1.0 END AS value FROM lineitem""",
)
def str_to_num_query(spark: SparkSession, folder: str) -> DataFrame:
    percent = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    text = d.choose(
        d.variant(5),
        F.format_number("l_extendedprice", 2),
        F.concat(percent, F.lit("%")),
        F.concat(F.lit("const_"), F.col("l_linenumber").cast("string")),
        F.lit("const_m1"),
        F.concat(d.price(), F.lit("d")),
    )
    return d.lines(spark, folder).select(row_id().alias("id"), str_to_num(text).alias("value"))


@query(
    "row_to_nums",
    f"""SELECT {SQL_ID} AS id, CAST(CASE WHEN ok THEN 3 ELSE -1 END AS INTEGER) AS n,
        CASE WHEN ok THEN round(l_extendedprice + l_quantity + round(l_discount * 100) / 100.0, 4)
        END AS total FROM (SELECT *, {sql_variant(3)} <> 0 AS ok FROM lineitem)""",
)
def row_to_nums_query(spark: SparkSession, folder: str) -> DataFrame:
    row = F.get(d.price_table(), F.when(d.variant(3) == 0, 3).otherwise(2))
    rows = d.lines(spark, folder).select(
        row_id().alias("id"), row_to_nums(F.slice(row, 2, 3)).alias("nums")
    )
    total = F.aggregate("nums", F.lit(0.0), lambda acc, x: acc + x)
    n = F.when(F.col("nums").isNotNull(), F.size("nums")).otherwise(-1)
    return rows.select("id", n.alias("n"), F.round(total, 4).alias("total"))


@query(
    "linearize",
    f"""SELECT {SQL_ID} AS id,
        'subtract(' || {SQL_P} || ', ' || {SQL_Q} || ') divide(#0, ' || {SQL_Q} || ')' AS program,
        'table_max(net sales, none)' AS listed FROM lineitem""",
)
def linearize(spark: SparkSession, folder: str) -> DataFrame:
    text = fill("  SUBTRACT( {P} ,{Q} ) ,\n modulo(1, 2), divide (#0,\t{Q}), add(1,000, {Q})")
    listed = F.array(*[F.lit(t) for t in ("table_max", "(", "net sales", ",", "none", ")")])
    return d.lines(spark, folder).select(
        row_id().alias("id"),
        linearize_program(text).alias("program"),
        linearize_tokens(listed).alias("listed"),
    )


@query(
    "dropped_steps",
    f"""SELECT {SQL_ID} AS id, CAST(CASE WHEN l_extendedprice >= 1000 THEN 1 ELSE 0 END AS INTEGER) AS dropped
        FROM lineitem""",
)
def dropped_steps_query(spark: SparkSession, folder: str) -> DataFrame:
    """Prices with thousands separators, whose commas hide a step."""
    price = F.format_number("l_extendedprice", 2)
    text = F.concat(F.lit("modulo(1, 2), Divide("), price, F.lit(", 2), add(#0, 1), table_max (a, none)"))
    return d.lines(spark, folder).select(row_id().alias("id"), dropped_steps(text).alias("dropped"))


@query(
    "tokenize_gold",
    f"""SELECT {SQL_ID} AS id, 'subtract(|' || {SQL_P} || '|' || {SQL_Q} || '|)|divide(|#0|' ||
        {SQL_Q} || '|)|EOF' AS tokens FROM lineitem""",
)
def tokenize_gold(spark: SparkSession, folder: str) -> DataFrame:
    listed = tokenize_program(fill(d.PRED_VARIANTS[0]))
    return d.lines(spark, folder).select(
        row_id().alias("id"), F.array_join(listed, "|").alias("tokens")
    )


@query(
    "parse_raw",
    f"""SELECT {SQL_ID} AS id, CASE {sql_variant(3)}
          WHEN 0 THEN 'divide,' || {SQL_P} || ',' || {SQL_Q} || ';Table_sum,net sales,none'
          WHEN 1 THEN 'add,#0,' || {SQL_Q} ELSE '' END AS steps FROM lineitem""",
)
def parse_raw(spark: SparkSession, folder: str) -> DataFrame:
    raw = d.choose(
        d.variant(3),
        fill(
            "add(1, 2) Program: divide({P}, {Q}) foo(1, 2)\nTable_sum( net sales , none )"
            "\n\nQuestion: add(1, 2)"
        ),
        fill("add(#0,{Q}) Explanation: add(3, 4)"),
        fill("nothing here ({P})"),
    )
    steps = F.transform(
        parse_raw_to_steps(raw), lambda s: F.concat_ws(",", s["op"], s["a"], s["b"])
    )
    return d.lines(spark, folder).select(row_id().alias("id"), F.array_join(steps, ";").alias("steps"))


@query(
    "steps_to_tokens",
    f"""SELECT {SQL_ID} AS id, CASE {sql_variant(2)}
          WHEN 0 THEN 'divide(|' || {SQL_P} || '|' || {SQL_Q} || '|)|EOF' ELSE 'EOF' END AS tokens
        FROM lineitem""",
)
def steps_to_tokens_query(spark: SparkSession, folder: str) -> DataFrame:
    raw = d.choose(d.variant(2), fill("divide({P}, {Q})"), F.lit("?"))
    listed = steps_to_tokens(parse_raw_to_steps(raw))
    return d.lines(spark, folder).select(
        row_id().alias("id"), F.array_join(listed, "|").alias("tokens")
    )


def _damaged() -> Column:
    """Token programs, whole and damaged in five ways."""
    whole = tokenize_program(fill("subtract({P}, {Q}), divide(#0, {Q})"))
    return d.choose(
        d.variant(7),
        whole,
        F.filter(whole, lambda t: t != ")"),
        F.slice(whole, 1, 8),
        F.concat(F.slice(whole, 1, 7), F.array(F.lit("EOF"))),
        tokenize_program(fill("Table_foo({P}, none)")),
        F.array(F.lit("EOF")),
        tokenize_program(fill("modulo({P}, {Q})")),
    )


@query(
    "verify_tokens",
    f"""SELECT {SQL_ID} AS id, {sql_variant(7)} IN (0, 4, 5) AS verified,
        {sql_variant(7)} IN (0, 2, 3, 5) AS structured FROM lineitem""",
)
def verify_tokens_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = d.lines(spark, folder).select(row_id().alias("id"), _damaged().alias("t"))
    return rows.select(
        "id",
        verify_tokens(F.col("t")).alias("verified"),
        structure_ok(F.col("t")).alias("structured"),
    )


@query(
    "format_stats",
    f"""SELECT total, valid, has_ops, empty, round(100.0 * valid / total, 1) AS valid_pct,
        round(100.0 * has_ops / total, 1) AS has_ops_pct, round(100.0 * empty / total, 1) AS empty_pct
        FROM (SELECT COUNT(*) AS total, COUNT(*) FILTER (v IN (0, 4, 5)) AS valid,
          COUNT(*) FILTER (v IN (0, 4)) AS has_ops, COUNT(*) FILTER (v = 5) AS empty
          FROM (SELECT {sql_variant(7)} AS v FROM lineitem))""",
)
def format_stats(spark: SparkSession, folder: str) -> DataFrame:
    return decode.format_stats(d.lines(spark, folder).select(_damaged().alias("predicted")))


# Equivalence, accuracy, candidates


@query(
    "program_equal",
    f"SELECT {SQL_ID} AS id, {sql_variant(6)} IN (0, 1, 2) AS equal FROM lineitem",
)
def program_equal(spark: SparkSession, folder: str) -> DataFrame:
    pred = d.choose(d.variant(6), *map(fill, d.EQUAL_VARIANTS))
    rows = d.lines(spark, folder).select(
        row_id().alias("id"),
        tokenize_program(fill(d.EQUAL_VARIANTS[0])).alias("gold"),
        tokenize_program(pred).alias("predicted"),
    )
    return with_equality(rows).select("id", "equal")


@query(
    "program_equal_more",
    f"SELECT {SQL_ID} AS id, {sql_variant(12)} IN (0, 1, 4, 6, 8, 10) AS equal FROM lineitem",
)
def program_equal_more(spark: SparkSession, folder: str) -> DataFrame:
    """Powers, comparisons and table steps."""
    pairs = (
        ("exp({P}, 2), greater(#0, {Q})", "exp({P}, 2), greater(#0, {Q})"),
        ("add({P}, {Q}), exp(#0, {D})", "add({Q}, {P}), exp(#0, {D})"),
        ("add({P}, {Q}), exp(#0, {D})", "add({Q}, {P}), exp(#0, {Q})"),
        ("greater({P}, {Q})", "greater({Q}, {P})"),
        ("table_max(rev, none), add(#0, {P})", "table_max(rev, none), add({P}, #0)"),
        ("table_max(rev, none), add(#0, {P})", "table_min(rev, none), add(#0, {P})"),
        ("table_sum(rev, none), divide(#0, {P})", "table_sum(rev, none), divide(#0, {P})"),
        ("greater({P}, {Q})", "subtract({P}, {Q})"),
        ("exp({P}, {Q}), exp({P}, {D}), multiply(#0, #1)", "add({Q}, {D}), exp({P}, #0)"),
        ("exp({P}, {Q}), exp({P}, {D}), multiply(#0, #1)", "multiply({Q}, {D}), exp({P}, #0)"),
        ("divide({Q}, {D}), exp({P}, #0), divide(#1, #1)", "exp({P}, {Q}), divide({D}, {D}), subtract({Q}, {Q}), exp(#1, #2)"),
        ("exp({P}, {D}), exp({Q}, {D}), add(#0, #1)", "add({P}, {Q}), exp(#0, {D})"),
    )
    gold, predicted = (d.choose(d.variant(12), *[fill(p[i]) for p in pairs]) for i in (0, 1))
    rows = d.lines(spark, folder).select(
        row_id().alias("id"),
        tokenize_program(gold).alias("gold"),
        tokenize_program(predicted).alias("predicted"),
    )
    return with_equality(rows).select("id", "equal")


SQL_SCORED = f"""scored AS (
  SELECT *, coalesce(num = gold, FALSE) AS exe_ok FROM (
    SELECT {SQL_ID} AS id, {sql_variant(8)} AS v,
      {r5("(l_extendedprice - l_quantity) / l_quantity")} AS gold,
      CASE {sql_variant(8)}
        WHEN 0 THEN {r5("(l_extendedprice - l_quantity) / l_quantity")}
        WHEN 1 THEN {r5("(l_extendedprice - l_quantity) / l_quantity")}
        WHEN 2 THEN {r5("l_extendedprice / l_quantity - l_quantity / l_quantity")}
        WHEN 3 THEN {r5("(l_quantity - l_extendedprice) / l_quantity")}
        WHEN 4 THEN {r5("(l_extendedprice - 1) / l_quantity")}
        WHEN 7 THEN {r5("l_extendedprice / l_quantity - 1")} END AS num
    FROM lineitem))"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.score(d.predictions(spark, folder), d.gold_examples(spark, folder))


@query(
    "accuracy",
    f"""WITH {SQL_SCORED} SELECT COUNT(*) AS total, COUNT(*) FILTER (exe_ok) AS exe_correct,
        COUNT(*) FILTER (v <= 2) AS prog_correct,
        round(COUNT(*) FILTER (exe_ok) / COUNT(*), 9) AS exe_acc,
        round(COUNT(*) FILTER (v <= 2) / COUNT(*), 9) AS prog_acc,
        COUNT(*) FILTER (v <= 2 AND NOT exe_ok) AS equal_but_mismatch,
        COUNT(*) FILTER (v = 2) AS equal_but_different_text, CAST(0 AS BIGINT) AS missing_gold,
        CAST(0 AS BIGINT) AS duplicate_gold FROM scored""",
)
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    report = evaluate.accuracy(_scored(spark, folder))
    return report.withColumns({c: F.round(c, 9) for c in ("exe_acc", "prog_acc")})


@query(
    "accuracy_repeated_gold",
    f"""WITH {SQL_SCORED} SELECT COUNT(*) AS total, COUNT(*) FILTER (exe_ok) AS exe_correct,
        COUNT(*) FILTER (v <= 2) AS prog_correct, CAST(0 AS BIGINT) AS missing_gold,
        COUNT(*) FILTER (v < 4) AS duplicate_gold FROM scored""",
)
def accuracy_repeated_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the gold ids come twice; the program that sorts first counts."""
    gold = d.gold_examples(spark, folder)
    again = d.lines(spark, folder).where(d.variant(8) < 4).select(
        row_id().alias("id"), F.lit("table_sum(x, none)").alias("program"), F.lit("0").alias("exe_ans")
    )
    report = evaluate.accuracy(evaluate.score(d.predictions(spark, folder), gold.unionByName(again)))
    return report.select("total", "exe_correct", "prog_correct", "missing_gold", "duplicate_gold")


@query(
    "attach_prediction",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, 'status ' || o_orderstatus AS question,
         'add(|' || c_custkey || '|1|)|EOF' AS predicted
       FROM customer LEFT JOIN orders ON c_custkey = o_orderkey""",
)
def attach_prediction(spark: SparkSession, folder: str) -> DataFrame:
    predictions = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.split(F.concat(F.lit("add(|"), "c_custkey", F.lit("|1|)|EOF")), r"\|").alias("predicted"),
    )
    question = F.concat(F.lit("status "), "o_orderstatus").alias("question")
    gold = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.struct(question).alias("qa")
    )
    rows = evaluate.attach_prediction(gold, predictions)
    return rows.select("id", "qa.question", F.array_join("qa.predicted", "|").alias("predicted"))


@query(
    "error_rows",
    f"""WITH {SQL_SCORED} SELECT id, CAST(num IS NULL AND v <> 6 AS INTEGER) AS invalid, num
        FROM scored WHERE NOT exe_ok""",
)
def error_rows(spark: SparkSession, folder: str) -> DataFrame:
    scored = evaluate.score(d.predictions(spark, folder), d.gold_examples(spark, folder), equality=False)
    return evaluate.error_rows(scored).select("id", "result.invalid", "result.num")


@query(
    "gold_dupes",
    "SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1",
)
def gold_dupes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.duplicate_ids(table(spark, folder, "lineitem"), "l_orderkey")


@query(
    "unmatched_predictions",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, o_orderkey IS NULL AS missing_gold
       FROM customer LEFT JOIN orders ON c_custkey = o_orderkey""",
)
def unmatched_predictions(spark: SparkSession, folder: str) -> DataFrame:
    preds = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    gold = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return evaluate.join_gold(preds, gold).select("id", "missing_gold")


@query(
    "select_candidate",
    f"""WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS id,
          row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sample_no,
          l_linenumber % 4 IN (0, 2) AND l_tax <> 0 AS ok,
          CASE l_linenumber % 4 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 9 ELSE 13 END AS len,
          CASE l_linenumber % 4
            WHEN 0 THEN 'divide(|' || {SQL_P} || '|' || CAST(CAST(l_tax AS DECIMAL(15,2)) AS VARCHAR) || '|)|EOF'
            WHEN 1 THEN 'EOF'
            WHEN 2 THEN 'divide(|' || {SQL_P} || '|' || CAST(CAST(l_tax AS DECIMAL(15,2)) AS VARCHAR) || '|)|add(|#0|' || {SQL_Q} || '|)|EOF'
            ELSE 'multiply(|' || {SQL_P} || '|ten|)|add(|#0|' || {SQL_Q} || '|)|divide(|#1|' || {SQL_Q} || '|)|EOF'
          END AS tokens FROM lineitem)
        SELECT id, coalesce(arg_min(tokens, sample_no) FILTER (ok),
          arg_max(tokens, len * 100000 - sample_no)) AS tokens FROM c GROUP BY id""",
)
def select_candidate(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decode.decode(d.candidates(spark, folder))
    chosen = decode.select_candidate(decoded, "id", *d.CANDIDATE_ORDER)
    return chosen.select("id", F.array_join("predicted", "|").alias("tokens"))


# Prompts


@query(
    "render_table",
    f"""SELECT {SQL_ID} AS id, 'item | value' || chr(10) || 'price | ' || {SQL_P} || chr(10) ||
        'note | None' || chr(10) || 'units: ' || {SQL_Q} || ' | rate: ' || CAST(l_discount AS VARCHAR) AS rendered
        FROM lineitem""",
)
def render_table(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(
        F.lit('[["item", "value"], ["price", "'),
        d.price(),
        F.lit('"], ["note", null], {"units": "'),
        d.quantity(),
        F.lit('", "rate": '),
        d.discount(),
        F.lit("}]"),
    )
    return d.lines(spark, folder).select(
        row_id().alias("id"), prompts.render_table_json(raw, F.lit(shapes.LIST)).alias("rendered")
    )


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_prompt(rule: str) -> str:
    head = _sql_literal(prompts._INTRO + rule + prompts._BEFORE_HEAD)
    return (
        f"{head} || 'Order ' || o_orderkey || ' .' || ' status ' || o_orderstatus || "
        f"{_sql_literal(prompts._TABLE_HEAD)} || 'priority | ' || o_orderpriority || chr(10) || "
        "'total | ' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || "
        f"{_sql_literal(prompts._AFTER_HEAD)} || '' || {_sql_literal(prompts._QUESTION_HEAD)} || "
        f"'total of ' || o_orderkey || ' ?' || {_sql_literal(prompts._PROMPT_END)}"
    )


@query(
    "prompts",
    f"""SELECT o_orderkey, {_sql_prompt(prompts.TRAIN_RULE)} AS train,
        '<user>' || {_sql_prompt(prompts.INFER_RULE)} || '<model>' AS infer FROM orders""",
)
def prompts_query(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    pre = F.array(
        F.concat(F.lit("Order "), key, F.lit(" .")),
        F.concat(F.lit("status "), F.col("o_orderstatus")),
    )
    grid = F.array(
        F.array(F.lit("priority"), F.col("o_orderpriority")),
        F.array(F.lit("total"), d.fixed("o_totalprice")),
    )
    question = F.concat(F.lit("total of "), key, F.lit(" ?"))

    def prompt(wording: str) -> Column:
        return prompts.user_prompt(
            prompts.join_sentences(pre),
            prompts.join_sentences(F.lit(None).cast("array<string>")),
            prompts.render_table(grid),
            question,
            wording,
        )

    return table(spark, folder, "orders").select(
        "o_orderkey",
        prompt("train").alias("train"),
        prompts.chat_wrap(prompt("infer"), "<user>", "<model>").alias("infer"),
    )


@query(
    "qa_template",
    f"""WITH {SQL_PAIRS} SELECT conv_id, turn, '### Question:' || chr(10) || question || chr(10) ||
        chr(10) || '### Answer:' || chr(10) || answer AS text FROM pairs""",
)
def qa_template(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select(
        "conv_id", "turn", prompts.qa_template(F.col("question"), F.col("answer")).alias("text")
    )


def _sql_fill(template: str, **slots: str) -> str:
    sql = _sql_literal(template)
    for name, expression in slots.items():
        sql = sql.replace("{" + name + "}", f"' || {expression} || '")
    return sql


@query(
    "pair_prompts",
    f"""WITH {SQL_PAIRS} SELECT conv_id, turn,
        {_sql_fill(prompts.QUESTION_PROMPT, chunk="question")} AS ask,
        {_sql_fill(prompts.ANSWER_PROMPT, chunk="question", question="question")} AS reply
        FROM pairs""",
)
def pair_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select(
        "conv_id",
        "turn",
        prompts.question_prompt(F.col("context")).alias("ask"),
        prompts.answer_prompt(F.col("context"), F.col("question")).alias("reply"),
    )


@query(
    "chunk_prompts",
    f"""SELECT doc_id, CAST((pos - 1) / 150 AS INTEGER) AS chunk_no,
        {_sql_fill(prompts.QUESTION_PROMPT, chunk="substr(text, pos, 200)")} AS ask
        FROM (SELECT doc_id, text, unnest(generate_series(1, length(text), 150)) AS pos
              FROM documents WHERE length(text) > 0)""",
)
def chunk_prompts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = corpus.chunk_fixed(table(spark, folder, "documents"))
    return chunks.select("doc_id", "chunk_no", prompts.question_prompt(F.col("text")).alias("ask"))


@query(
    "typed_text",
    """SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE doc_id % 3 WHEN 0 THEN '[' || text WHEN 1 THEN '["' || text || '"] ' || source
           ELSE array_to_string(string_split(text, chr(10)), ' ') END AS pre,
         '' AS post, CASE WHEN doc_id % 2 = 0 THEN 'lang: ' || lang || chr(10) || 'long: ' ||
           CASE WHEN n_chars > 1500 THEN 'True' ELSE 'False' END ELSE '{' || text END AS table_text,
         '' AS question FROM documents""",
)
def typed_text(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose texts are JSON strings or lists and often begin like JSON themselves."""
    docs = table(spark, folder, "documents")

    def record(pre: Column) -> Column:
        keyed = F.struct("lang", (F.col("n_chars") > 1500).alias("long"))
        id_ = F.col("doc_id").cast("string").alias("id")
        with_table = F.to_json(F.struct(id_, pre.alias("pre_text"), keyed.alias("table_ori")))
        brace = F.concat(F.lit("{"), "text").alias("table")
        return F.when(F.col("doc_id") % 2 == 0, with_table).otherwise(
            F.to_json(F.struct(id_, pre.alias("pre_text"), brace))
        )

    rows = docs.select(
        F.when(F.col("doc_id") % 3 == 0, record(F.concat(F.lit("["), "text")))
        .when(F.col("doc_id") % 3 == 1, record(F.concat(F.lit('["'), "text", F.lit('"] '), "source")))
        .otherwise(record(F.split("text", "\n")))
        .alias("record")
    )
    typed = typed_examples(rows)
    rendered = prompts.render_table_json(F.col("table_json"), F.col("table_kind"))
    return typed.select("id", "pre", "post", rendered.alias("table_text"), "question")


@query(
    "typed_programs",
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS id,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'total ' || o_orderkey || ' ?' END AS question,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'add(' || o_orderkey || ', 1) divide(#0, 2)' END AS program_text,
         CAST(CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS dropped_steps,
         CASE o_orderkey % 3 WHEN 1 THEN 'yes' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) END AS exe_ans,
         CASE o_orderkey % 3 WHEN 1 THEN 'string' WHEN 2 THEN 'number' ELSE 'null' END AS exe_ans_kind FROM orders""",
)
def typed_programs(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose program is text, a token list or missing, some without an id."""
    key = F.col("o_orderkey").cast("string")
    third = F.col("o_orderkey") % 3
    question = F.concat(F.lit("total "), key, F.lit(" ?")).alias("question")
    text = F.concat(F.lit("ADD( "), key, F.lit(",1), exp(1,000, 2), divide(#0, 2)")).alias("program")
    tokens_ = F.concat(F.lit("add|(|"), key, F.lit("|,|1|)|divide|(|#0|,|2|)"))
    listed = F.split(tokens_, r"\|").alias("program")
    id_ = F.when(F.col("o_orderkey") % 5 != 0, key).alias("id")
    record = (
        F.when(third == 1, F.to_json(F.struct(id_, F.struct(question, text, F.lit("yes").alias("exe_ans")).alias("qa"))))
        .when(third == 2, F.to_json(F.struct(id_, F.struct(question, listed, F.col("o_orderkey").alias("exe_ans")).alias("qa"))))
        .otherwise(F.to_json(F.struct(id_, F.lit("x").alias("other"))))
    )
    typed = typed_examples(table(spark, folder, "orders").select(record.alias("record")))
    program, kind = F.col("program"), F.col("program_kind")
    return typed.select(
        "id",
        "question",
        linear_program(program, kind).alias("program_text"),
        dropped_steps(program_text(program, kind)).alias("dropped_steps"),
        "exe_ans",
        "exe_ans_kind",
    )


# Subsets


@query("few_shot", "SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 200")
def few_shot(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang")
    return sample.first_rows(docs, 200, "doc_id")


SQL_SPLIT = """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
  <= ceil(0.1 * (SELECT COUNT(*) FROM documents)) THEN 'test' ELSE 'train' END AS split
  FROM documents"""


def _split(spark: SparkSession, folder: str, name: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return sample.with_split(docs, "doc_id", 0.1, 42).where(F.col("split") == name)


@query("split_test", f"SELECT * FROM ({SQL_SPLIT}) WHERE split = 'test'")
def split_test(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, "test")


@query("split_train", f"SELECT * FROM ({SQL_SPLIT}) WHERE split = 'train'")
def split_train(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, "train")


@query("split_sizes", f"SELECT split, COUNT(*) AS rows FROM ({SQL_SPLIT}) GROUP BY split")
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return sample.with_split(docs, "doc_id").groupBy("split").agg(F.count("*").alias("rows"))


# Cleaning and chunks

SQL_SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"


def sql_clean(text: str, scaled: str = "t") -> str:
    """The cleaning rules as nested SQL; ``scaled`` rewrites scaled amounts in ``t``."""
    steps = [
        f"lower({text})",
        r"regexp_replace(t, 'page \d+', '', 'g')",
        "regexp_replace(t, 'sarb.*report', '', 'g')",
        "regexp_replace(t, '[©®]', '', 'g')",
        f"replace(replace(t, '{cleaning.PUBLISHER}', ''), '{cleaning.RIGHTS}', '')",
        scaled,
        r"regexp_replace(t, '(?i)r([\d,\.]+)', '\1 ZAR', 'g')",
        r"regexp_replace(t, '\n+', chr(10), 'g')",
        "regexp_replace(t, '[ ]+', ' ', 'g')",
        r"regexp_replace(t, '(\w+)-\n(\w+)', '\1\2', 'g')",
        f"trim(t, {SQL_SPACES})",
    ]
    inner = "SELECT *, {} AS t FROM {{source}}".format(steps[0])
    for step in steps[1:]:
        inner = f"SELECT * REPLACE ({step} AS t) FROM ({inner})"
    return inner


@query(
    "clean_text",
    "SELECT doc_id, t AS text FROM (" + sql_clean("text").format(source="documents") + ")",
)
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents"))
    cleaned = cleaning.clean_text(F.col("text"), unicode_classes=False)
    return docs.select("doc_id", cleaned.alias("text"))


@query(
    "clean_report",
    "SELECT o_orderkey, t AS text FROM ("
    + sql_clean(
        "raw",
        "replace(t, 'r' || amount || ' million', "
        "format('{{:,}}', CAST(trunc(CAST(amount AS DOUBLE) * 1e6) AS BIGINT)) || ' ZAR')",
    ).format(
        source="""(SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS amount,
          'Page 12 SARB Annual Report' || chr(10) || chr(10) || ' ©  Revenue infla-' || chr(10) ||
          'tion of R' || amount || ' Million  and R' || amount || ' in the year.' || chr(10) ||
          'All Rights Reserved ' AS raw FROM orders)"""
    )
    + ")",
)
def clean_report(spark: SparkSession, folder: str) -> DataFrame:
    amount = d.fixed("o_totalprice")
    raw = F.concat(
        F.lit("Page 12 SARB Annual Report\n\n ©  Revenue infla-\ntion of R"),
        amount,
        F.lit(" Million  and R"),
        amount,
        F.lit(" in the year.\nAll Rights Reserved "),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))
    cleaned = cleaning.clean_text(F.col("raw"), unicode_classes=False)
    return orders.select("o_orderkey", cleaned.alias("text"))


@query(
    "currency_scaled",
    """SELECT o_orderkey, CASE o_orderkey % 3
         WHEN 0 THEN 'sum ' || format('{:,}', CAST(trunc(p * 1e6) AS BIGINT)) || ' ZAR.'
         WHEN 1 THEN 'sum ' || format('{:,}', CAST(trunc(p / 1000 * 1e9) AS BIGINT)) || ' ZAR, ' ||
           format('{:,}', CAST(trunc(p * 1e6) AS BIGINT)) || ' ZAR'
         ELSE 'sum r1.2.3 million' END AS text
       FROM (SELECT o_orderkey, o_totalprice AS p FROM orders)""",
)
def currency_scaled(spark: SparkSession, folder: str) -> DataFrame:
    amount = d.fixed("o_totalprice")
    thousandth = (F.col("o_totalprice") / 1000).cast("string")
    text = d.choose(
        F.col("o_orderkey") % 3,
        F.concat(F.lit("sum r"), amount, F.lit(" million.")),
        F.concat(F.lit("sum r "), thousandth, F.lit(" billion, R"), amount, F.lit(" million")),
        F.lit("sum r1.2.3 million"),
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", cleaning.scale_currency(text).alias("text")
    )


@query(
    "currency_trillion",
    """SELECT o_orderkey, format('{:,}', CAST(o_orderkey AS HUGEINT) * 1500000000000) || ' ZAR of ' ||
         format('{:,}', CAST(o_orderkey AS HUGEINT) * 17179869184 * 1000000000) || ' ZAR' AS text FROM orders""",
)
def currency_trillion(spark: SparkSession, folder: str) -> DataFrame:
    """Whole amounts far beyond 64 bits."""
    half = (F.col("o_orderkey") * 1.5).cast("decimal(20,1)").cast("string")
    text = F.concat(F.lit("r"), half, F.lit(" trillion of R "), (F.col("o_orderkey") * 17179869184).cast("string"), F.lit(" billion"))
    return table(spark, folder, "orders").select("o_orderkey", cleaning.scale_currency(text).alias("text"))


@query(
    "page_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
        '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""",
)
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", cleaning.strip_markup(F.col("html")).alias("text")
    )


@query(
    "assemble_pages",
    """SELECT doc_id, string_agg(line, chr(10) ORDER BY page_no) || chr(10) AS text FROM (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents)
       WHERE line <> '' GROUP BY doc_id""",
)
def assemble_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text")
    )
    return corpus.assemble_pages(pages)


@query(
    "chunk_fixed",
    """SELECT doc_id, CAST((pos - 1) / 150 AS INTEGER) AS chunk_no, substr(text, pos, 200) AS text
       FROM (SELECT doc_id, text, unnest(generate_series(1, length(text), 150)) AS pos
             FROM documents WHERE length(text) > 0)""",
)
def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.chunk_fixed(spread(table(spark, folder, "documents")))


@query(
    "first_chunks",
    """SELECT doc_id, chunk_no, text FROM (
         SELECT doc_id, CAST((pos - 1) / 150 AS INTEGER) AS chunk_no, substr(text, pos, 200) AS text
         FROM (SELECT doc_id, text, unnest(generate_series(1, length(text), 150)) AS pos
               FROM documents WHERE length(text) > 0))
       ORDER BY doc_id, chunk_no LIMIT 50""",
)
def first_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = corpus.chunk_fixed(table(spark, folder, "documents"))
    return sample.first_rows(chunks, 50, "doc_id", "chunk_no")


def _sql_recursive(docs: str = "documents", number: str = "INTEGER") -> str:
    """Chunks cut at separators: segments level by level, runs of short pieces, greedy merging.

    A segment is cut at the coarsest of the remaining separators that it holds; long pieces are
    segments of the next level. ``marks`` are the borders of a run; a chunk goes from one mark to
    the last that keeps it within the size, the next one starts where at most the overlap repeats.
    """
    levels, runs = [], []
    for k in range(4):
        source = (
            f"SELECT doc_id, text, 0::BIGINT AS s, length(text) AS e, 0 AS lvl FROM {docs} WHERE length(text) > 0"
            if k == 0
            else f"SELECT doc_id, text, ps AS s, pe AS e, idx + 1 AS lvl FROM piece{k - 1} WHERE long"
        )
        levels.append(f"""seg{k} AS (SELECT *, substr(text, s + 1, e - s) AS t FROM ({source})),
  cut{k} AS (SELECT *, CASE idx WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) ELSE ' ' END AS sep FROM (
    SELECT *, CASE WHEN lvl <= 0 AND contains(t, chr(10) || chr(10)) THEN 0
      WHEN lvl <= 1 AND contains(t, chr(10)) THEN 1 WHEN lvl <= 2 AND contains(t, ' ') THEN 2 ELSE 3 END AS idx
    FROM seg{k})),
  part{k} AS (SELECT doc_id, text, s, e, idx, length(sep) AS w, unnest(string_split(t, sep)) AS part,
      generate_subscripts(string_split(t, sep), 1) AS nth FROM cut{k} WHERE idx < 3),
  border{k} AS (SELECT DISTINCT doc_id, text, s, e, idx, CAST(s + sum(length(part)) OVER upto + (nth - 1) * w AS BIGINT) AS pe
    FROM part{k} WINDOW upto AS (PARTITION BY doc_id, s ORDER BY nth)),
  piece{k} AS (SELECT *, pe - ps >= 200 AS long FROM (
    SELECT *, lag(pe, 1, s) OVER (PARTITION BY doc_id, s ORDER BY pe) AS ps FROM border{k} WHERE pe > s)),
  island{k} AS (SELECT *, count(*) FILTER (long) OVER (PARTITION BY doc_id, s ORDER BY pe) AS island FROM piece{k})""")
        runs.append(f"""SELECT doc_id, text, list_concat([min(ps)], list(pe ORDER BY pe)) AS marks FROM island{k}
      WHERE NOT long GROUP BY doc_id, text, s, island
    UNION ALL SELECT doc_id, text, range(s, e + 1) FROM cut{k} WHERE idx = 3""")
    last = "greatest({f} + 1, len(list_filter(marks, lambda m: m <= marks[{f}] + 200)))"
    return f"""WITH RECURSIVE {", ".join(levels)},
  run AS (SELECT doc_id, text, list_transform(marks, lambda m: CAST(m AS BIGINT)) AS marks FROM ({" UNION ALL ".join(runs)})),
  merged AS (SELECT *, 1::BIGINT AS f, {last.format(f="1")}::BIGINT AS l FROM run
    UNION ALL SELECT doc_id, text, marks, g, {last.format(f="g")}::BIGINT FROM (
      SELECT doc_id, text, marks, least(l, len(list_filter(marks, lambda m:
        m < greatest(marks[l] - 50, marks[l + 1] - 200))) + 1)::BIGINT AS g FROM merged WHERE l < len(marks))),
  chunk AS (SELECT doc_id, marks[f] AS start, trim(substr(text, marks[f] + 1, marks[l] - marks[f]),
      {_sql_literal(WHITESPACE)}) AS text FROM merged)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS {number}) AS chunk_no, text
  FROM chunk WHERE text <> ''"""


@query("chunk_recursive", _sql_recursive())
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.chunk_recursive(spread(table(spark, folder, "documents")))


@query(
    "chunk_parts",
    _sql_recursive(
        """(SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn NULLS FIRST, md5(text)) AS text
          FROM conversations GROUP BY conv_id)""",
        "BIGINT",
    ),
)
def chunk_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as documents, their turns as parts."""
    turns = table(spark, folder, "conversations").withColumnRenamed("conv_id", "doc_id")
    return long_texts.chunk_parts(turns, part="turn")


@query("chunk_sources")
def chunk_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All texts of a source one after the other as one document; SQL takes the square of its length."""
    docs = table(spark, folder, "documents")
    return long_texts.chunk_parts(docs, doc="source", part="doc_id")


@query(
    "chunk_collection",
    """SELECT DISTINCT sha256(doc_id || '|' || chunk_no || '|' || text) AS id, text, source FROM (
         SELECT doc_id, CAST((pos - 1) / 150 AS INTEGER) AS chunk_no, substr(text, pos, 200) AS text,
           CAST(doc_id AS VARCHAR) AS source
         FROM (SELECT doc_id, text, unnest(generate_series(1, length(text), 150)) AS pos
               FROM documents WHERE length(text) > 0))""",
)
def chunk_collection(spark: SparkSession, folder: str) -> DataFrame:
    records = corpus.chunk_records(corpus.chunk_fixed(table(spark, folder, "documents")))
    return records.select("id", "text", F.col("metadata")["source"].alias("source"))


# Retrieval and similarity


@query(
    "knn_top3",
    """SELECT query_id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id
           ORDER BY round(score, 9) DESC, neighbour_id) AS rank
         FROM (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id,
             list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
           FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0))
       WHERE rank <= 3""",
)
def knn_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The query set are the ids divisible by 100; each meets every vector."""
    vectors = table(spark, folder, "embeddings")
    found = retrieve.nearest(vectors.where("vec_id % 100 = 0"), vectors, 3, skip_self=True)
    return found.select("query_id", "neighbour_id", "rank", F.round("score", 6).alias("score"))


@query(
    "cosine_pairs",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
       AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    left = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    value = similarity.cosine(F.col("a"), F.col("b"))
    return left.join(right, "vec_id").select("vec_id", F.round(value, 6).alias("cosine"))


# Question-answer pairs


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.conversation_pairs(table(spark, folder, "conversations"))


@query("qa_pairs", f"WITH {SQL_PAIRS} SELECT conv_id, turn, question, answer, source FROM pairs")
def qa_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).drop("context")


@query(
    "qa_pairs_gaps",
    f"""WITH {SQL_PAIRS} SELECT conv_id, turn * (turn + 3) AS turn, question, answer, source FROM pairs""",
)
def qa_pairs_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The same turns under numbers with growing gaps."""
    turns = table(spark, folder, "conversations")
    apart = turns.withColumn("turn", F.col("turn") * (F.col("turn") + 3))
    return corpus.conversation_pairs(apart).drop("context")


def sql_reading(text: str) -> str:
    w = f"len(regexp_extract_all(lower({text}), '\\S+'))"
    s = f"greatest(len(regexp_extract_all(lower({text}), '[.!?]+')), 1)"
    y = f"greatest(len(regexp_extract_all(lower({text}), '[aeiouy]+')), {w})"
    return (
        f"CASE WHEN {w} > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * ({w} / {s}) "
        f"- 84.6::DOUBLE * ({y} / {w}) ELSE 0.0 END"
    )


SQL_CLARITY = f"({sql_reading('question')} + {sql_reading('answer')}) / 2"
# Longest common subsequence by thresholds: the k-th is the least place in the question at which a
# common subsequence of k tokens ends; each token of the answer lowers some of them.
SQL_SCORES = f"""{SQL_PAIRS},
  toks AS (SELECT *, regexp_extract_all(lower(answer), '[a-z0-9]+') AS a,
    regexp_extract_all(lower(question), '[a-z0-9]+') AS s,
    list_distinct({sql_words("answer")}) AS aw, list_distinct({sql_words("question")}) AS sw
    FROM pairs),
  placed AS (SELECT *, list_transform(a, lambda t: list_filter(range(1, len(s) + 1), lambda i: s[i] = t)) AS places
    FROM toks),
  folded AS (SELECT *, list_reduce(list_concat([list_filter([0::BIGINT], lambda z: z > 0)], places), lambda t, p:
      list_filter(list_transform(range(1, len(t) + 2), lambda k: least(coalesce(t[k], 1000000),
        coalesce(list_min(list_filter(p, lambda q: q > CASE WHEN k = 1 THEN 0 ELSE t[k - 1] END)), 1000000))),
        lambda x: x < 1000000)) AS ends FROM placed),
  scores AS (SELECT *,
    CASE WHEN len(a) = 0 OR len(s) = 0 THEN 0.0 ELSE 2.0 * len(ends) / (len(a) + len(s)) END AS rouge,
    coalesce(len(list_intersect(aw, sw)) / nullif(sqrt(len(aw) * len(sw)), 0), 0.0) AS faith,
    {SQL_CLARITY} AS clear FROM folded)"""


@query(
    "readability",
    f"WITH {SQL_PAIRS} SELECT conv_id, turn, round({SQL_CLARITY}, 4) AS clarity FROM pairs",
)
def readability(spark: SparkSession, folder: str) -> DataFrame:
    value = quality.clarity(F.col("question"), F.col("answer"))
    return _pairs(spark, folder).select("conv_id", "turn", F.round(value, 4).alias("clarity"))


@query("rouge_l", f"WITH {SQL_SCORES} SELECT conv_id, turn, round(rouge, 6) AS rouge_l FROM scores")
def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    value = quality.rouge_l(F.col("answer"), F.col("context"))
    return _pairs(spark, folder).select("conv_id", "turn", F.round(value, 6).alias("rouge_l"))


@query(
    "qa_quality",
    f"""WITH {SQL_SCORES} SELECT COUNT(*) AS pairs, round(avg(faith), 6) AS faithfulness,
        round(avg(clear), 4) AS clarity, round(avg(rouge), 6) AS rouge_l FROM scores""",
)
def qa_quality(spark: SparkSession, folder: str) -> DataFrame:
    report = workflows.pair_report(workflows.pair_scores(_pairs(spark, folder)))
    return report.select(
        "pairs",
        F.round("faithfulness", 6).alias("faithfulness"),
        F.round("clarity", 4).alias("clarity"),
        F.round("rouge_l", 6).alias("rouge_l"),
    )


@query("vector_faithfulness")
def vector_faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each answer and its context in the space of all of them; SQL has no decomposition."""
    pairs = _pairs(spark, folder).select("conv_id", "turn", "answer", "context")
    pairs = pairs.withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    space = text_vectors.fit(pairs.select(F.explode(F.array("answer", "context")).alias("text")))
    sides = [
        text_vectors.embed(space, pairs, "id", side).select(F.col("row").alias("id"), F.col("vector").alias(f"of_{side}"))
        for side in ("answer", "context")
    ]
    value = similarity.cosine(F.col("of_answer"), F.col("of_context"))
    both = pairs.join(sides[0], "id").join(sides[1], "id")
    return both.select("conv_id", "turn", F.round(value, 4).alias("cosine"))


SQL_TERMS = f"""{SQL_PAIRS}, counts AS (SELECT term, COUNT(*) AS n FROM (
  SELECT unnest(list_concat({sql_words("answer")}, {sql_words("question")})) AS term FROM pairs)
  GROUP BY term)"""


def _term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.term_counts(_pairs(spark, folder), "answer", "question")


@query("term_counts", f"WITH {SQL_TERMS} SELECT term, n FROM counts")
def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder)


@query(
    "term_stats",
    f"WITH {SQL_TERMS} SELECT COUNT(*) AS unique_terms, CAST(SUM(n) AS BIGINT) AS words FROM counts",
)
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.term_stats(_term_counts(spark, folder))


def sql_merges(merges: int) -> str:
    """CTEs ``best0``, ``words1``, ...: each merge of the most frequent pair, and the words after it."""
    # Empty text splits into one empty symbol, which the terms do not have.
    steps = ["words0 AS (SELECT string_split(term, '') AS symbols, n FROM counts)"]
    for k in range(merges):
        steps.append(
            f"""best{k} AS (SELECT a, b FROM (
                SELECT symbols[i] AS a, symbols[i + 1] AS b, n FROM (
                  SELECT symbols, n, unnest(range(1, len(symbols))) AS i FROM words{k}))
                GROUP BY a, b HAVING sum(n) >= 2 ORDER BY sum(n) DESC, a, b LIMIT 1),
            words{k + 1} AS (SELECT n, list_reduce(list_transform(symbols, lambda x: [x]), lambda made, x:
                CASE WHEN made[-1] = a AND x[1] = b THEN list_append(made[1:len(made) - 1], a || b)
                  ELSE list_concat(made, x) END) AS symbols FROM words{k}, best{k})"""
        )
    return ", ".join(steps)


SUBWORD_MERGES = 8


@query(
    "subword_merges",
    f"WITH {SQL_TERMS}, {sql_merges(SUBWORD_MERGES)} "
    + " UNION ALL ".join(f'SELECT {k} AS "rank", a AS "left", b AS "right" FROM best{k}' for k in range(SUBWORD_MERGES)),
)
def subword_merges(spark: SparkSession, folder: str) -> DataFrame:
    merges = subwords.learn_merges(_term_counts(spark, folder), SUBWORD_MERGES)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank int, left string, right string")


@query(
    "subword_pieces",
    f"""WITH {SQL_TERMS}, {sql_merges(SUBWORD_MERGES)} SELECT piece, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT unnest(symbols) AS piece, n FROM words{SUBWORD_MERGES}) GROUP BY piece""",
)
def subword_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """How often each piece occurs in the corpus, whose words are cut text by text."""
    merges = subwords.learn_merges(_term_counts(spark, folder), SUBWORD_MERGES)
    texts = _pairs(spark, folder).select(corpus.terms(F.col("answer"), F.col("question")).alias("words"))
    cut = subwords.cut_words(texts, "words", merges)
    return cut.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


@query("top_terms", f"WITH {SQL_TERMS} SELECT term, n FROM counts ORDER BY n DESC, term LIMIT 15")
def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.top_terms(_term_counts(spark, folder))


# Token arrays

SQL_VOCAB = f"""{SQL_TERMS}, vocab AS (SELECT term, n,
  row_number() OVER (ORDER BY n DESC, md5(term), term) + 1 AS token_id FROM counts)"""
SQL_ENCODED = f"""{SQL_VOCAB}, qw AS (
    SELECT conv_id, turn, unnest({sql_words("question")}) AS term,
      generate_subscripts({sql_words("question")}, 1) AS pos FROM pairs),
  aw AS (SELECT conv_id, turn, unnest({sql_words("answer")}) AS term,
      generate_subscripts({sql_words("answer")}, 1) AS pos FROM pairs),
  q AS (SELECT conv_id, turn, list(token_id ORDER BY pos) AS ids FROM qw JOIN vocab USING (term)
        GROUP BY conv_id, turn),
  a AS (SELECT conv_id, turn, list(token_id ORDER BY pos) AS ids FROM aw JOIN vocab USING (term)
        GROUP BY conv_id, turn),
  packed AS (SELECT conv_id || '-' || turn AS id, coalesce(q.ids, []) AS prompt_ids,
      coalesce(a.ids, []) AS target_ids,
      list_concat(coalesce(q.ids, []), coalesce(a.ids, [])) AS ids
    FROM pairs LEFT JOIN q USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn))"""


def _vocab(pairs: DataFrame) -> DataFrame:
    return tokens.build_vocab(checkpointed(corpus.term_counts(pairs, "answer", "question")))


def _pair_words(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        words(F.col("question"), lower=True).alias("prompt"),
        words(F.col("answer"), lower=True).alias("target"),
    )


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    """``id, input_ids, attention_mask, labels`` of the pairs; ids 0 and 1 are no term's."""
    pairs = checkpointed(_pairs(spark, folder))
    return _pack(_pair_words(pairs), checkpointed(_vocab(pairs)))


def _pack(rows: DataFrame, terms: DataFrame) -> DataFrame:
    sized = rows.select("id", F.concat("prompt", "target").alias("all"), F.size("prompt").alias("p"))
    both = checkpointed(tokens.encode(sized, "id", F.col("all"), terms, keep=("p",)))
    packed = packing.pack(
        F.slice("ids", F.lit(1), F.col("p")),
        F.slice("ids", F.col("p") + 1, F.size("ids") - F.col("p")),
    )
    return both.select("id", packed.alias("packed")).select("id", "packed.*")


@query("vocab", f"WITH {SQL_VOCAB} SELECT term, n, CAST(token_id AS BIGINT) AS token_id FROM vocab")
def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return _vocab(_pairs(spark, folder))


@query(
    "pack",
    f"""WITH {SQL_ENCODED} SELECT id, array_to_string(ids, ' ') AS input_ids,
        CAST(len(ids) AS INTEGER) AS mask_sum,
        array_to_string(list_concat(list_transform(prompt_ids, lambda x: -100), target_ids), ' ') AS labels
        FROM packed""",
)
def pack(spark: SparkSession, folder: str) -> DataFrame:
    mask = F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x)
    return _packed(spark, folder).select(
        "id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        mask.alias("mask_sum"),
        F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"),
    )


@query(
    "pack_repeated",
    f"""WITH {SQL_ENCODED} SELECT CASE WHEN conv_id % 3 = 0 THEN '' ELSE CAST(conv_id % 7 AS VARCHAR) END AS id,
        array_to_string(list_transform(ids, lambda i: CASE WHEN i - 2 < common THEN i ELSE 1 END), ' ') AS input_ids,
        array_to_string(list_concat(list_transform(prompt_ids, lambda x: -100),
          list_transform(target_ids, lambda i: CASE WHEN i - 2 < common THEN i ELSE 1 END)), ' ') AS labels
        FROM packed JOIN pairs ON id = conv_id || '-' || turn,
          (SELECT count(*) AS common FROM counts WHERE n >= 3)""",
)
def pack_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with empty and repeated ids; words of one or two occurrences are not in the vocabulary."""
    pairs = checkpointed(_pairs(spark, folder))
    rows = _pair_words(pairs).withColumn("conv", F.split_part("id", F.lit("-"), F.lit(1)).cast("long"))
    key = F.when(F.col("conv") % 3 == 0, "").otherwise((F.col("conv") % 7).cast("string"))
    known = checkpointed(_vocab(pairs).where("n >= 3"))
    packed = _pack(rows.withColumn("id", key).drop("conv"), known)
    return packed.select(
        "id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"),
    )


@query(
    "pad",
    f"""WITH {SQL_ENCODED} SELECT id,
        array_to_string(list_concat(ids[1:256], list_transform(range(greatest(256 - len(ids), 0)),
          lambda i: 0)), ' ') AS input_ids,
        CAST(least(len(ids), 256) AS INTEGER) AS mask_sum, CAST(256 AS INTEGER) AS length,
        CAST(least(len(ids), 2048) AS INTEGER) AS cut FROM packed""",
)
def pad(spark: SparkSession, folder: str) -> DataFrame:
    padded = _packed(spark, folder).select(
        "id", packing.pad(F.col("input_ids")).alias("p"), packing.truncate(F.col("input_ids")).alias("t")
    )
    return padded.select(
        "id",
        F.array_join(F.col("p.input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.aggregate("p.attention_mask", F.lit(0), lambda acc, x: acc + x).alias("mask_sum"),
        F.size("p.attention_mask").alias("length"),
        F.size("t").alias("cut"),
    )


@query(
    "collate",
    f"""WITH {SQL_ENCODED}, placed AS (SELECT id, ids,
          CAST(floor((row_number() OVER (ORDER BY md5('42:' || id), id) - 1) / 16) AS BIGINT) AS batch_no
          FROM packed),
        sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_no) AS longest FROM placed)
        SELECT id, batch_no,
          array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda i: 0)), ' ')
            AS input_ids,
          CAST(len(ids) AS INTEGER) AS mask_sum,
          array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda i: -100)), ' ')
            AS labels FROM sized""",
)
def collate(spark: SparkSession, folder: str) -> DataFrame:
    batches = tokens.collate(_packed(spark, folder), "id", 16)
    return batches.select(
        "id",
        "batch_no",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x).alias("mask_sum"),
        F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"),
    )


# A vocabulary size that many rows exceed, so that the checks find something.
SMALL_VOCAB = 400


def _token_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Token arrays straight from ``lineitem``: some ids negative or too large."""
    ids = F.array(F.col("l_linenumber"), F.col("l_quantity").cast("int") * 8 - 10)
    labels = F.array(F.lit(-100), F.col("l_quantity").cast("int") * 9 - 5).cast("array<bigint>")
    return d.lines(spark, folder).select(
        row_id().alias("id"),
        F.col("l_returnflag").alias("split"),
        ids.alias("input_ids"),
        labels.alias("labels"),
    )


SQL_TOKENS = f"""toks AS (SELECT {SQL_ID} AS id, l_returnflag AS split,
  CAST(l_quantity AS INTEGER) * 8 - 10 AS i, CAST(l_quantity AS INTEGER) * 9 - 5 AS l FROM lineitem),
  flagged AS (SELECT *, i < 0 OR i >= {SMALL_VOCAB} AS bad_i, l >= {SMALL_VOCAB} AS bad_l FROM toks)"""


@query(
    "token_check",
    f"""WITH {SQL_TOKENS} SELECT id, CASE WHEN bad_i THEN CAST(i AS VARCHAR) ELSE '' END AS bad_inputs,
        CASE WHEN bad_l THEN CAST(l AS VARCHAR) ELSE '' END AS bad_labels
        FROM flagged WHERE bad_i OR bad_l""",
)
def token_check(spark: SparkSession, folder: str) -> DataFrame:
    bad = tokens.find_bad_tokens(_token_rows(spark, folder), SMALL_VOCAB)
    return bad.select(
        "id",
        F.array_join(F.col("bad_inputs").cast("array<string>"), " ").alias("bad_inputs"),
        F.array_join(F.col("bad_labels").cast("array<string>"), " ").alias("bad_labels"),
    )


@query(
    "token_report",
    f"""WITH {SQL_TOKENS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY id) AS rn
          FROM flagged WHERE bad_i OR bad_l)
        SELECT split, rows, issues, first_bad, issues = 0 AS passed FROM (
          SELECT split, COUNT(*) AS rows, COUNT(*) FILTER (bad_i OR bad_l) AS issues
          FROM flagged GROUP BY split)
        LEFT JOIN (SELECT split, string_agg(id, ' ' ORDER BY id) AS first_bad FROM ranked
          WHERE rn <= 10 GROUP BY split) USING (split)""",
)
def token_report(spark: SparkSession, folder: str) -> DataFrame:
    report = tokens.token_report(_token_rows(spark, folder), SMALL_VOCAB)
    return report.withColumn("first_bad", F.array_join("first_bad", " "))


@query(
    "issue_sample",
    f"""WITH {SQL_TOKENS} SELECT id, CASE WHEN bad_i THEN CAST(i AS VARCHAR) ELSE '' END AS bad_inputs,
        CASE WHEN bad_l THEN CAST(l AS VARCHAR) ELSE '' END AS bad_labels
        FROM flagged WHERE bad_i OR bad_l ORDER BY id LIMIT 3""",
)
def issue_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.issue_sample(_token_rows(spark, folder), SMALL_VOCAB)
    return rows.select(
        "id",
        F.array_join(F.col("bad_inputs").cast("array<string>"), " ").alias("bad_inputs"),
        F.array_join(F.col("bad_labels").cast("array<string>"), " ").alias("bad_labels"),
    )


@query(
    "tensor_columns",
    f"""WITH {SQL_TOKENS} SELECT l_linenumber || ' ' || i AS input_ids, '1 1' AS attention_mask, '-100 ' || l AS labels
        FROM (SELECT toks.*, l_linenumber FROM toks JOIN (SELECT {SQL_ID} AS id, l_linenumber FROM lineitem) USING (id))""",
)
def tensor_columns_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = _token_rows(spark, folder).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    kept = tensor_columns(rows)
    return kept.select(*[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in kept.columns])


# Run metrics


@query(
    "best_run",
    """SELECT event_type AS metric, arg_min(user_id, (value, user_id)) AS run_id, min(value) AS value
       FROM (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, value FROM events
             WHERE value IS NOT NULL)
       GROUP BY event_type""",
)
def best_run_query(spark: SparkSession, folder: str) -> DataFrame:
    metrics = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("metric"), "value"
    )
    return best_run(metrics.where(F.col("value").isNotNull()))
