"""Grounded answers over ranked products, their validation, and judgment pools."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.hooks import Generator

# Roles, decisions and words that an answer may or may not use.
ROLES = ("exact", "substitute", "irrelevant")
DECISIONS = ("recommend_exact", "recommend_exact_with_warning", "recommend_substitute", "no_good_match", "ask_clarification")
FORBIDDEN = ("price", "stock", "review", "rating", "shipping", "discount")
REASON = "This candidate appears near the top of the grounded retrieval results and has matching catalog metadata worth comparing with the request."
IMAGE_REASON = "This is the highest-ranked visual candidate from the multimodal retrieval results; the catalog metadata should be checked against any unstated preferences."
RESPONSE = "The first result is the closest grounded candidate from this search set; compare its listed type, material, color, and style details with your request before choosing."
EVIDENCE = ("product_type", "color", "material", "style")

NEED = "struct<category:string,use_case:string,positive_preferences:array<string>,negative_constraints:array<string>,visual_preferences:array<string>,uncertain_fields:array<string>>"
JUDGEMENT = "struct<product_id:string,role:string,evidence:array<string>,constraint_violations:array<string>,reason:string>"
ANSWER = f"struct<query_id:string,interpreted_need:{NEED},product_judgements:array<{JUDGEMENT}>,decision:string,customer_response:string>"


def extract_json(text: str | None) -> str | None:
    """The JSON object in a model's output: a fenced or bare object, else the first balanced {...}; null if none parses."""
    t = (text or "").strip()
    if t.startswith("```"):
        t = t.split("\n", 1)[1] if "\n" in t else t[3:]
        t = t.rsplit("```", 1)[0].strip()
    for candidate in (t, _balanced(t)):
        try:
            if candidate and isinstance(json.loads(candidate), dict):
                return candidate
        except ValueError:
            pass
    return None


def _balanced(t: str) -> str | None:
    start = t.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(max(start, 0), len(t) if start >= 0 else 0):
        ch = t[i]
        if quoted:
            quoted, escaped = not (ch == '"' and not escaped), ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        else:
            depth += (ch == "{") - (ch == "}")
            if depth == 0:
                return t[start : i + 1]
    return None


def parse(raw: Column) -> Column:
    """The answer struct of a model's output; null if it holds no object. Items of a wrong type are null."""
    pick = F.arrow_udf(lambda a: pa.array([extract_json(x) for x in a.to_pylist()], pa.string()), "string")
    return F.from_json(pick(raw), ANSWER)


def violations(answer: Column, query_id: Column, allowed: Column) -> Column:
    """What is wrong with an answer, as an array of messages; ``allowed`` holds the ranked product identifiers."""
    need, js, said = answer["interpreted_need"], answer["product_judgements"], answer["customer_response"]
    low = F.lower(said)
    bad = lambda test, msg: F.when(F.coalesce(test, F.lit(True)), F.lit(msg))
    tests = [
        bad(answer.isNull() | answer["query_id"].isNull() | need.isNull() | js.isNull() | answer["decision"].isNull() | said.isNull(), "missing keys"),
        bad(answer["query_id"] != query_id, "query_id mismatch"),
        bad(need["category"].isNull(), "interpreted_need.category must be a string"),
        *[bad(need[f].isNull(), f"interpreted_need.{f} must be a list") for f in ("positive_preferences", "negative_constraints", "visual_preferences", "uncertain_fields")],
        bad(F.size(js) == 0, "product_judgements must be a non-empty list"),
        bad(F.exists(js, lambda j: ~F.coalesce(F.array_contains(allowed, j["product_id"]), F.lit(False))), "product_id outside the ranked products"),
        bad(F.exists(js, lambda j: ~F.coalesce(j["role"].isin(*ROLES), F.lit(False))), "invalid role"),
        bad(F.exists(js, lambda j: j["evidence"].isNull()), "evidence must be a list"),
        bad(F.exists(js, lambda j: j["constraint_violations"].isNull()), "constraint_violations must be a list"),
        bad(F.exists(js, lambda j: F.trim(F.coalesce(j["reason"], F.lit(""))) == ""), "judgement reason is missing"),
        bad(~answer["decision"].isin(*DECISIONS), "invalid decision"),
        bad(F.size(F.filter(F.split(said, r"(?U)\s+"), lambda w: w != "")) < 8, "customer_response is too short"),
        *[bad(low.contains(w), f"customer_response uses: {w}") for w in FORBIDDEN],
    ]
    return F.array_compact(F.array(*tests))


def _catalog(products: DataFrame) -> DataFrame:
    """``products`` as a side of a join that is never sent whole to all tasks: files of a catalog are far smaller than its rows in memory."""
    return products.hint("merge")


def fallback(queries: DataFrame, hits: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, answer) without a model: the first five hits as substitutes with their catalog values as evidence.

    ``queries`` has query_id, query_type, query_text; ``hits`` query_id,
    product_id, rank; ``products`` product_id, title and any evidence columns.
    """
    has = [c for c in EVIDENCE if c in products.columns]
    kinds = dict(products.dtypes)
    value = lambda c: F.trim(T.safe_text(F.col(c), kinds[c]))
    none = F.array().cast("array<string>")
    listed = F.array_distinct(F.filter(F.array(*[value(c) for c in has]), lambda x: x != "")) if has else none
    p = products.select("product_id", value("title").alias("__title"), listed.alias("__ev"), (value("product_type") if "product_type" in has else F.lit("")).alias("__type"))
    t = hits.where("rank <= 5").join(_catalog(p), "product_id").join(queries.select("query_id", "query_type"), "query_id")
    first = (F.col("rank") == 1) & (F.col("query_type") == "image")
    one = F.struct(F.col("rank"), F.struct(F.col("product_id").cast("string").alias("product_id"), F.lit("substitute").alias("role"), F.when(F.size("__ev") > 0, F.col("__ev")).otherwise(F.array("__title")).alias("evidence"), none.alias("constraint_violations"), F.when(first, IMAGE_REASON).otherwise(REASON).alias("reason")).alias("j"), F.col("__type"))
    t = t.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("xs"))
    t = queries.join(t, "query_id", "left")
    pos, neg = T.infer_need(F.col("query_text"))
    js = F.coalesce(F.col("xs.j"), F.array().cast(f"array<{JUDGEMENT}>"))
    kind = F.coalesce(F.nullif(F.get(F.col("xs.__type"), F.lit(0)), F.lit("")), F.when(F.col("query_type") == "image", F.lit("visual match")).otherwise(F.lit("product")))
    visual = F.when(F.col("query_type").isin("image", "image_text"), F.array(F.lit("similar to the provided image"))).otherwise(none)
    need = F.struct(kind.alias("category"), F.lit("").alias("use_case"), pos.alias("positive_preferences"), neg.alias("negative_constraints"), visual.alias("visual_preferences"), none.alias("uncertain_fields"))
    decision = F.when(F.size(js) > 0, "recommend_substitute").otherwise("no_good_match")
    return t.select("query_id", F.struct(F.col("query_id").cast("string").alias("query_id"), need.alias("interpreted_need"), js.alias("product_judgements"), decision.alias("decision"), F.lit(RESPONSE).alias("customer_response")).alias("answer"))


def prompts(queries: DataFrame, hits: DataFrame, products: DataFrame, top: int = 8) -> DataFrame:
    """(query_id, prompt): instructions, the request and up to ``top`` products as JSON, descriptions cut at 1000."""
    fields = {"title": "title", "product_type": "product_type", "category_path": "category", "brand": "brand", "color": "color", "material": "material", "style": "style", "description": "description"}
    kinds = dict(products.dtypes)
    cols = [(F.substring(T.safe_text(F.col(c), kinds[c]), 1, 1000) if c == "description" else T.safe_text(F.col(c), kinds[c])).alias(n) if c in kinds else F.lit("").alias(n) for c, n in fields.items()]
    p = products.select(F.col("product_id"), F.to_json(F.struct(F.col("product_id").cast("string").alias("product_id"), *cols)).alias("__j"))
    t = hits.where(F.col("rank") <= top).join(_catalog(p), "product_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "__j"))).alias("xs"))
    t = queries.join(t, "query_id", "left")
    image = F.when(F.col("query_image_path").isNotNull(), "yes").otherwise("no") if "query_image_path" in queries.columns else F.lit("no")
    lines = [
        F.lit("Answer as a product search assistant with one JSON object and nothing else. Use only the products listed; invent no attribute; respect what the request excludes."),
        F.concat(F.lit("Query ID: "), F.col("query_id").cast("string")), F.concat(F.lit("Query type: "), "query_type"),
        F.concat(F.lit("Query text: "), F.coalesce(F.nullif("query_text", F.lit("")), F.lit("[none]"))), F.concat(F.lit("Query image: "), image),
        F.lit(f"Roles: {', '.join(ROLES)}. Decisions: {', '.join(DECISIONS)}."),
        F.concat(F.lit("Products: ["), F.coalesce(F.array_join(F.col("xs.__j"), ", "), F.lit("")), F.lit("]")),
    ]
    return t.select("query_id", F.concat_ws("\n", *lines).alias("prompt"))


def answer(queries: DataFrame, hits: DataFrame, products: DataFrame, generator: Generator | None = None, attempts: int = 3, top: int = 8) -> DataFrame:
    """(query_id, answer, status, n_attempts): direct, repair or fallback.

    Each further attempt names the faults of the one before. Attempts are columns
    of one plan; a query that has a valid answer isn't asked again.
    """
    base = queries.select("query_id")
    fall = fallback(queries, hits, products).withColumnRenamed("answer", "__fall")
    if generator is None:
        return base.join(fall, "query_id").select("query_id", F.col("__fall").alias("answer"), F.lit("fallback").alias("status"), F.lit(0).alias("n_attempts"))
    allowed = hits.where(F.col("rank") <= top).groupBy("query_id").agg(F.collect_set(F.col("product_id").cast("string")).alias("allowed"))
    t = base.join(prompts(queries, hits, products, top), "query_id").join(allowed, "query_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))

    def ask(p: pa.Array) -> pa.Array:
        rows = p.to_pylist()
        todo = [i for i, x in enumerate(rows) if x is not None]
        got = dict(zip(todo, generator.generate([rows[i] for i in todo]), strict=True)) if todo else {}
        return pa.array([got.get(i) for i in range(len(rows))], pa.string())

    call = F.arrow_udf(ask, "string")
    t = t.withColumns({"answer": F.lit(None).cast(ANSWER), "n_attempts": F.lit(0), "__faults": F.array().cast("array<string>")})
    for k in range(attempts):
        again = F.concat(F.col("prompt"), F.lit("\nYour last answer was invalid: "), F.array_join("__faults", "; "))
        t = t.withColumn("__raw", call(F.when(F.col("answer").isNull(), F.when(F.size("__faults") > 0, again).otherwise(F.col("prompt")))))
        t = t.withColumn("__try", parse(F.col("__raw")))
        t = t.withColumn("__bad", violations(F.col("__try"), F.col("query_id").cast("string"), F.col("allowed")))
        new = F.col("answer").isNull()
        t = t.withColumns({"n_attempts": F.when(new, F.lit(k + 1)).otherwise(F.col("n_attempts")), "__faults": F.when(new, F.col("__bad")).otherwise(F.col("__faults")), "answer": F.when(new & (F.size("__bad") == 0), F.col("__try")).otherwise(F.col("answer"))})
    status = F.when(F.col("answer").isNull(), "fallback").when(F.col("n_attempts") == 1, "direct").otherwise("repair")
    return t.join(fall, "query_id").select("query_id", F.coalesce("answer", "__fall").alias("answer"), status.alias("status"), "n_attempts")


def sft_dataset(prompts_: DataFrame, targets: DataFrame, fallbacks: DataFrame, allowed: DataFrame) -> DataFrame:
    """(query_id, prompt, target): the given answer where it is valid, else the fallback, as JSON."""
    t = prompts_.join(targets.withColumnRenamed("answer", "__t"), "query_id", "left").join(fallbacks.withColumnRenamed("answer", "__f"), "query_id").join(allowed, "query_id", "left")
    ok = F.col("__t").isNotNull() & (F.size(violations(F.col("__t"), F.col("query_id").cast("string"), F.col("allowed"))) == 0)
    return t.select("query_id", "prompt", F.to_json(F.when(ok, F.col("__t")).otherwise(F.col("__f"))).alias("target"), ok.alias("given"))


def judgment_pool(lists: list[tuple[DataFrame, bool]], rest: DataFrame, queries: DataFrame, per_run: int = 8, size: int = 20) -> DataFrame:
    """(query_id, doc_id, pos): the ordered union of the heads of ``lists``, then of ``rest``; first occurrences, at most ``size``.

    Each list is (results with query_id, doc_id, rank; whether image queries have it).
    """
    text = queries.where("query_type <> 'image'").select("query_id")
    out = None
    for p, (t, image) in enumerate([*lists, (rest, True)]):
        t = t.where(F.col("rank") <= per_run) if p < len(lists) else t
        t = (t if image else t.join(text, "query_id", "left_semi")).select("query_id", "doc_id", F.lit(p).alias("p"), "rank")
        out = t if out is None else out.unionByName(t)
    first = out.groupBy("query_id", "doc_id").agg(F.min(F.struct("p", "rank")).alias("at"))
    pos = F.row_number().over(W.partitionBy("query_id").orderBy("at", "doc_id"))
    return first.withColumn("pos", pos).where(F.col("pos") <= size).select("query_id", "doc_id", "pos")


def small_pools(pool: DataFrame, least: int = 10) -> DataFrame:
    """Queries whose pool is too small to be judged."""
    return pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def qrels_violations(annotated: DataFrame, order: str) -> DataFrame:
    """(row, violation) of annotations (``order``, query_id, product_id, relevance, reason); columns are text.

    A repeated pair is reported once and not looked at further, as is a grade that is no integer.
    """
    n = F.row_number().over(W.partitionBy("query_id", "product_id").orderBy(order))
    grade = F.expr("try_cast(trim(cast(relevance as string)) as double)")
    t = annotated.select(F.col(order).alias("row"), n.alias("__n"), grade.alias("g"), F.trim(F.coalesce("reason", F.lit(""))).alias("r"))
    whole = F.coalesce(F.col("g") == F.floor("g"), F.lit(False))
    msgs = F.when(F.col("__n") > 1, F.array(F.lit("duplicate pair"))).when(~whole, F.array(F.lit("relevance must be 0, 1, or 2"))).otherwise(
        F.array_compact(F.array(F.when(~F.col("g").isin(0.0, 1.0, 2.0), F.lit("relevance is invalid")), F.when(F.col("r") == "", F.lit("reason is empty")), F.when(F.lower("r").startswith("auto:"), F.lit("auto-generated labels are not allowed")))))
    return t.select("row", F.explode(msgs).alias("violation"))


def finalize_qrels(annotated: DataFrame, order: str) -> DataFrame:
    """The qrels; reading them raises an error if any annotation is invalid."""
    missing = {"query_id", "product_id", "relevance", "reason"} - set(annotated.columns)
    if missing:
        raise ValueError(f"annotations lack columns: {sorted(missing)}")
    bad = qrels_violations(annotated, order).limit(30).collect()
    if bad:
        raise ValueError("cannot finalize qrels:\n" + "\n".join(f"row {r['row']}: {r['violation']}" for r in bad))
    return annotated.select("query_id", "product_id", F.col("relevance").cast("double").cast("int").alias("relevance"), F.trim("reason").alias("reason"))


def qrels_coverage(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, queries without judgments, least and most judgments of a query."""
    per = queries.select("query_id").join(qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").na.fill(0)
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") == 0).alias("missing"), F.min("n").alias("least"), F.max("n").alias("most"))
