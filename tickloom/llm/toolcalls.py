"""Tool-call linking for chat data, with DataFrame functions alone.

Calls and results are joined by identifier (a hash join, results first reduced to one row per identifier), arguments are
checked against schemas, the calls of each conversation are put in an order in which each follows the calls it depends
on, and each linked call becomes one line of canonical JSON (sorted keys, no blanks, null values left out).

Order: where every dependency has a smaller position than its call, the order by position is topological. Only the
conversations with a dependency that stands later get levels (the longest chain of dependencies below a call). A round
settles the calls whose dependencies are settled, and lets every dependency on a call that waits for one other call alone
point to that other call, with the steps added up: chains halve, so that one of n calls takes about log2(n) rounds. Calls
that remain are on or behind a cycle, are marked, and come last by position.

Edge cases: repeated rows stay and are marked `duplicate id`; a call without id, name, position or conversation stays and
is marked; null arguments count as none. No result is lost: a call carries its smallest result, each further text for it
is a row of its own marked `further result`, and each text for an identifier that no call has (or none at all) one marked
`no call`; such rows have no name, position and seq, and count equal results in n_results. Empty tables give an empty
table; further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import materialize, small_enough

CHUNK = 64  # positions ranked together, so that a long conversation is ranked by many tasks
MAX_SCHEMAS = 10_000  # rows of the schema table that may be broadcast
#: What a value of each schema type looks like.
TYPE_PATTERNS = {"string": r"(?s).*", "integer": r"-?(?:0|[1-9][0-9]*)", "number": r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", "boolean": r"true|false"}


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls of conversations with a dependency that does not stand before its call."""
    at = calls.groupBy("conv_id", "call_id").agg(F.min("position").alias("at"))
    edges = calls.select("conv_id", "call_id", "position", F.explode("after").alias("needs"))
    edges = edges.join(at.select("conv_id", F.col("call_id").alias("needs"), "at"), ["conv_id", "needs"])
    edges = materialize(edges.select("conv_id", "call_id", "needs", (F.col("at") >= F.col("position")).alias("late")).distinct())
    odd = edges.where("late").select("conv_id").distinct()
    keys = ["conv_id", "call_id"]
    settled = calls.limit(0).select(*keys, F.lit(0).alias("level"))
    if small_enough(odd, 0):
        return settled
    waiting = materialize(calls.join(odd, "conv_id").select(*keys, F.lit(0).alias("base")).distinct())  # a call's level is at least `base`
    links = materialize(edges.join(odd, "conv_id").select(*keys, "needs", F.lit(1).alias("steps")))  # and at least that of `needs` plus `steps`
    while True:
        ready = materialize(waiting.join(links.select(*keys).distinct(), keys, "left_anti"))
        if small_enough(ready, 0):  # every call that waits leads to a cycle
            break
        settled = settled.union(ready.select(*keys, F.col("base").alias("level")))
        done = ready.select("conv_id", F.col("call_id").alias("needs"), F.col("base").alias("level"))
        met = materialize(links.join(done, ["conv_id", "needs"], "left").select(*keys, "needs", "steps", (F.col("level") + F.col("steps")).alias("bound")))
        open_links = met.where("bound IS NULL").drop("bound")
        alone = open_links.groupBy(*keys).agg(F.count("*").alias("n"), F.first("needs").alias("beyond"), F.first("steps").alias("more")).where("n = 1")
        bounds = met.groupBy(*keys).agg(F.max("bound").alias("bound"))
        waiting = materialize(waiting.join(ready, keys, "left_anti").join(bounds, keys, "left").select(*keys, F.greatest("base", F.coalesce("bound", "base")).alias("base")))
        alone = alone.join(waiting, keys).select("conv_id", F.col("call_id").alias("needs"), "beyond", "more", F.col("base").alias("least"))
        passed = open_links.join(alone, ["conv_id", "needs"], "left")
        passed = passed.select(*keys, F.coalesce("beyond", "needs").alias("needs"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("least") + F.col("steps")).alias("bound"))
        links = materialize(passed.groupBy(*keys, "needs").agg(F.max("steps").alias("steps"), F.max("bound").alias("bound")))
        bounds = links.groupBy(*keys).agg(F.max("bound").alias("bound"))
        waiting = waiting.join(bounds, keys, "left").select(*keys, F.greatest("base", F.coalesce("bound", "base")).alias("base"))
        waiting, links = materialize(waiting), links.drop("bound")
    return materialize(settled.union(waiting.select(*keys, F.lit(None).cast("int"))))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds `argument_errors` to calls (name, arguments): by `schemas` (name, parameter, type, required)."""
    rules = (schemas.where("name IS NOT NULL AND parameter IS NOT NULL")
             .groupBy(F.col("name").alias("rule_name"))
             .agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("parameter", F.struct("type", F.coalesce("required", F.lit(False)).alias("required")))))).alias("rules")))
    rules = F.broadcast(rules) if small_enough(schemas, MAX_SCHEMAS) else rules
    kinds = F.create_map(*[F.lit(x) for kv in TYPE_PATTERNS.items() for x in (kv[0], f"^(?:{kv[1]})$")])
    joined = calls.join(rules, calls["name"] == rules["rule_name"], "left")
    given = F.coalesce("arguments", F.create_map().cast("map<string,string>"))
    missing = F.filter(F.map_keys("rules"), lambda p: F.col("rules")[p]["required"] & given[p].isNull())
    unknown = F.filter(F.map_keys(given), lambda p: ~F.map_contains_key("rules", p))

    def wrong(p: Column) -> Column:
        pattern = kinds[F.col("rules")[p]["type"]]
        return F.map_contains_key("rules", p) & given[p].isNotNull() & ~F.coalesce(F.regexp_like(given[p], pattern), F.lit(False))

    label = lambda what, names: F.transform(F.array_sort(names), lambda p: F.concat(F.lit(what + " "), p))
    errors = F.concat(label("missing", missing), label("unknown", unknown), label("wrong type", F.filter(F.map_keys(given), wrong)))
    return joined.withColumn("argument_errors", F.when(F.col("rules").isNull(), F.array(F.lit("no schema"))).otherwise(errors)).drop("rule_name", "rules")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, name, position, seq, n_results, errors, json), one row for each call, then one for each text of a result that no row of a call carries.

    calls: conv_id, call_id, name, position, arguments (map of strings), after (ids that the call depends on).
    results: conv_id, call_id, content.
    """
    calls = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), F.col("name").cast("string").alias("name"),
                         F.col("position").cast("long").alias("position"), F.col("arguments").cast("map<string,string>").alias("arguments"),
                         F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    texts = results.groupBy("conv_id", F.col("call_id").cast("string").alias("call_id"), "content").agg(F.count("*").alias("n"))
    answers = texts.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.sum("n").alias("n_results"), F.min("content").alias("content"))
    times = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("times"))
    known = calls.where("call_id IS NOT NULL").select("conv_id", F.col("call_id").alias("needs")).distinct()
    absent = (calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("needs")).where("needs IS NOT NULL")
              .join(known, ["conv_id", "needs"], "left_anti").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("needs")).alias("absent")))
    levels = _levels(calls).withColumn("odd", F.lit(True))
    keys = ["conv_id", "call_id"]
    out = argument_errors(calls, schemas).join(answers, keys, "left").join(times, keys, "left").join(absent, keys, "left").join(levels, keys, "left")

    cyclic = F.col("odd").isNotNull() & F.col("level").isNull()
    one = lambda condition, text: F.when(condition, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(
        one(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no id"), one(F.col("position").isNull(), "no position"),
        one(F.coalesce("times", F.lit(1)) > 1, "duplicate id"), F.col("argument_errors"),
        F.coalesce(F.transform("absent", lambda a: F.concat(F.lit("no call "), a)), F.array().cast("array<string>")), one(cyclic, "cycle"),
        one(F.coalesce("n_results", F.lit(0)) == 0, "no result"), one(F.coalesce("n_results", F.lit(0)) > 1, "several results"))

    # rank by (cyclic, level, position) within a conversation, in two steps: chunks of positions, then within a chunk
    out = out.select("conv_id", "call_id", "name", "position", "arguments", "content", F.coalesce("n_results", F.lit(0)).alias("n_results"), errors.alias("errors"),
                     cyclic.alias("_c"), F.coalesce("level", F.lit(0)).alias("_l"), F.floor(F.coalesce("position", F.lit(-1)) / CHUNK).alias("_k"))
    chunk = ["conv_id", "_c", "_l", "_k"]
    sizes = out.groupBy(*chunk).agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("_c", "_l", "_k").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*[F.col(c).alias("f" + c) for c in chunk], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(*chunk).orderBy("position", "call_id", "name", "content")
    out = out.withColumn("_own", F.row_number().over(own) - 1)
    same = [F.col(c).eqNullSafe(F.col("f" + c)) for c in chunk]
    out = out.join(firsts, same[0] & same[1] & same[2] & same[3]).withColumn("seq", F.col("_first") + F.col("_own"))
    given = F.map_filter(F.coalesce("arguments", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    sorted_arguments = F.map_from_entries(F.array_sort(F.map_entries(given)))
    line = F.to_json(F.struct(sorted_arguments.alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"), "seq"))
    linked = out.select("conv_id", "call_id", "name", "position", "seq", "n_results", F.array_join("errors", "; ").alias("errors"), line.alias("json"))
    return linked.unionByName(_other_results(texts, answers, calls))


def _other_results(texts: DataFrame, answers: DataFrame, calls: DataFrame) -> DataFrame:
    """The texts of results (conv_id, call_id, content, n) that are not the one their call carries."""
    keys = ["conv_id", "call_id"]
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select(*keys, F.lit(True).alias("known")).distinct()
    rest = texts.join(answers.select(*keys, F.col("content").alias("carried")), keys, "left").join(known, keys, "left")
    rest = rest.where(F.col("known").isNull() | ~F.col("content").eqNullSafe(F.col("carried")))
    none = lambda kind: F.lit(None).cast(kind)
    line = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")))
    return rest.select("conv_id", "call_id", none("string").alias("name"), none("long").alias("position"), none("long").alias("seq"), F.col("n").alias("n_results"),
                       F.when(F.col("known"), "further result").otherwise("no call").alias("errors"), line.alias("json"))


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results (conv_id, call_id, content) whose identifier no call has."""
    known = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id")).distinct()
    return results.select("conv_id", F.col("call_id").cast("string").alias("call_id"), "content").join(known, ["conv_id", "call_id"], "left_anti")


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text), which state no calls: these are made of the turns.

    A system turn calls `configure`, a user turn `reply`; an assistant turn is the result of the turn before it. Arguments:
    the text as `prompt`, the turn, and as `limit` the length of the text, which is left out where it is a multiple of 11
    and is the first word instead where it is a multiple of 3. By the first digit of md5(turn:text), a call depends on the
    call two turns earlier (0 to 3), on the one two turns later (e and f), or on none.
    """
    turn = F.col("turn").cast("long")
    named = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    ident = lambda t: F.when(F.col("conv_id").isNotNull() & t.isNotNull(), named(t))
    rows = conversations.select("conv_id", turn.alias("turn"), "role", "text")
    asked = rows.where("role IN ('system', 'user')")
    digit = F.substring(F.md5(F.concat_ws(":", F.col("turn").cast("string"), F.coalesce("text", F.lit("")))), 1, 1)
    after = (F.when(digit.isin("0", "1", "2", "3") & (F.col("turn") >= 2), F.array(ident(F.col("turn") - 2)))
             .when(digit.isin("e", "f"), F.array(ident(F.col("turn") + 2))))
    size = F.length("text")
    limit = F.when(size % 11 != 0, F.when(size % 3 == 0, F.split_part("text", F.lit(" "), F.lit(1))).otherwise(size.cast("string")))
    arguments = F.create_map(F.lit("prompt"), F.col("text"), F.lit("turn"), F.col("turn").cast("string"), F.lit("limit"), limit)
    calls = asked.select("conv_id", ident(F.col("turn")).alias("call_id"), F.when(F.col("role") == "system", "configure").otherwise("reply").alias("name"),
                         F.col("turn").alias("position"), arguments.alias("arguments"), after.alias("after"))
    results = rows.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def turn_schemas(spark) -> DataFrame:
    rows = [(name, p, kind, p != "limit" or name == "reply") for name in ("configure", "reply") for p, kind in (("prompt", "string"), ("turn", "integer"), ("limit", "integer"))]
    return spark.createDataFrame(rows, "name string, parameter string, type string, required boolean")
