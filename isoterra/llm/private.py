"""Personal data: base patterns, and terms that disclose it by what the corpus says.

Base spans are e-mail and IP addresses, card and phone numbers. They are protected entities. Of the terms of an entity's
documents, the corpus tells how much they give away: pmi(term, entity) = log2(N * n(term, entity) / (n(term) * n(entity)))
against the entity's own information log2(N / n(entity)), with every n counted over whole documents. A term that is in at
least SUPPORT of the entity's documents and gives at least DISCLOSURE of its information is a span wherever it stands in
the documents that hold the entity, and is generalised.

Everything is DataFrame functions. A pattern that matches cannot be matched with backing off, so the repetitions are
possessive: the same matches, and no deep recursion on long runs of digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from isoterra.llm import shared

#: Fixed patterns: kind, pattern, what a text must contain to be searched, what takes a span's place.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", "<EMAIL>"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "<IP>"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", "<CARD>"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "<PHONE>"),
}
TERM = "<TERM>"
#: Share of an entity's information that discloses it; documents that must show both.
DISCLOSURE, SUPPORT = 0.9, 2
#: A term: a run of letters, in lower case.
WORD = r"\p{L}{4,64}+(?!\p{L})"
#: What stands for a letter of a base span (a code point that no text means), and a run that may hold it: then it
#: overlaps the span and is no term.
MASK = "\uffff"
MASKED_WORD = r"[\p{L}\x{ffff}]{4,64}+(?![\p{L}\x{ffff}])"
SPAN = "struct<rank:int,kind:string,start:int,end:int,value:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True where the digits' checksum holds: from the right, every second digit doubled, less nine if over nine."""
    each = F.reverse(F.split(digits, ""))
    values = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(12, 19) & _luhn(_digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of the matches that hold, in code points."""
    pattern, hint, _ = KINDS[kind]
    order = list(KINDS).index(kind)
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # a match starts after the pieces of text before it and the matches between those
    walked = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")),
        F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.concat(
                acc["out"],
                F.when(
                    _holds(kind, x["m"]),
                    F.array(F.struct(
                        F.lit(order).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + F.length(x["b"])).alias("start"),
                        (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"),
                    )),
                ).otherwise(F.expr(NO_SPANS)),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(hint), walked).otherwise(F.expr(NO_SPANS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, base: Column) -> Column:
    """The text at the same places, with MASK for each letter of the base spans; a MASK of its own is a space."""
    text = F.translate(text, MASK, " ")
    walked = F.aggregate(
        base, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, s: F.when(s["end"] > acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.array(
                F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.regexp_replace(F.substring(text, F.greatest(acc["at"], s["start"]) + 1, s["end"] - F.greatest(acc["at"], s["start"])), r"\p{L}", MASK),
            )).alias("out"),
        )).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))),
    )
    return F.array_join(walked, "")


def _terms(text: Column, pattern: str) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _placed(masked: Column, given: Column) -> Column:
    """Spans of every occurrence of the given terms in a masked text, by start."""
    found, between = F.regexp_extract_all(masked, F.lit(MASKED_WORD), F.lit(0)), F.split(masked, MASKED_WORD, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), start.alias("start"), end.alias("end"), F.lower(x["m"]).alias("value"))
        return F.struct(end.alias("at"), F.when(F.array_contains(given, F.lower(x["m"])), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")),
        F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("out")), step, lambda acc: acc["out"],
    )


def find_private(docs: DataFrame) -> DataFrame:
    """Spans of personal data in documents (doc_id, text): every column, and base and terms.

    base and terms are arrays of (rank, kind, start, end, value) by start, then kind as listed, with code points and an
    exclusive end. A null or empty text has none. Repeated rows count as documents each. A term that overlaps a base
    span is none. Rows without doc_id are searched like others. Columns named base or terms are replaced.
    """
    rows, name = shared.numbered(docs)
    return _found(rows, name).select(*(F.col(name[c]).alias(c) for c in docs.columns if c not in ("base", "terms")), "base", "terms")


def _found(docs: DataFrame, name: dict[str, str]) -> DataFrame:
    """The rows of numbered docs with base and terms."""
    body = F.coalesce(F.col(name["text"]).cast("string"), F.lit(""))
    found = docs.withColumn("body", body)
    found = found.withColumn("base", F.array_sort(
        F.flatten(F.array(*(_spans(F.col("body"), k) for k in KINDS))),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]),
    ))
    found = found.withColumn("key", F.xxhash64(F.col(name["doc_id"]).cast("string"), "body"))  # never null: clean rows are spread too
    held = found.where(F.size("base") > 0).select(
        F.monotonically_increasing_id().alias("row"), "key", _masked(F.col("body"), F.col("base")).alias("masked"),
        F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"]))).alias("entities"),
    )
    held = shared.written(held, "private-held")
    given = _disclosing(docs.select(F.col(name["text"]).alias("text")), held).groupBy("row").agg(F.collect_set("term").alias("given"))
    # rows that are the same in id and text have the same spans
    spans = held.join(given, "row").select("key", _placed(F.col("masked"), F.col("given")).alias("terms")).groupBy("key").agg(F.first("terms").alias("terms"))
    return found.join(spans.hint("shuffle_hash"), "key", "left").withColumn("terms", F.coalesce("terms", F.expr(NO_SPANS))).drop("key", "body")


def _disclosing(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (row, term) of held: a term of the document that gives away one of its entities."""
    total = float(max(1, docs.count()))
    pairs = held.select("row", F.explode("entities").alias("entity"))
    entities = shared.written(pairs.groupBy("entity").agg(F.count("*").alias("of_entity")).where(F.col("of_entity") >= SUPPORT), "private-entities")
    # of_both <= of_entity, so that a term in more documents than this gives too little whatever it is seen with
    most = F.col("of_entity") * F.pow(total / F.col("of_entity"), F.lit(1 - DISCLOSURE)) * (1 + 1e-9)
    top = entities.agg(F.max(most)).first()[0] or 0.0
    pairs = shared.written(pairs.join(entities.where(F.col("of_entity") < total), "entity"), "private-pairs")
    words = docs.select(F.explode(_terms(F.col("text").cast("string"), WORD)).alias("term"))
    of_term = words.groupBy("term").agg(F.count("*").alias("of_term")).where(F.col("of_term").between(SUPPORT, top))
    seen = held.join(pairs.select("row").distinct(), "row", "left_semi").select("row", F.explode(_terms(F.col("masked"), MASKED_WORD)).alias("term"))
    seen = seen.where(~F.contains("term", F.lit(MASK))).join(of_term, "term")
    both = shared.written(seen.join(pairs, "row").where(F.col("of_term") <= most).select("row", "term", "of_term", "entity", "of_entity"), "private-both")
    information = F.log2(total / F.col("of_entity"))
    pmi = F.log2(total * F.col("of_both") / (F.col("of_term") * F.col("of_entity")))
    gives = both.groupBy("term", "entity", "of_term", "of_entity").agg(F.count("*").alias("of_both")).where(F.col("of_both") >= SUPPORT)
    gives = gives.where((information > 0) & (pmi >= DISCLOSURE * information)).select("term", "entity")
    return both.join(gives, ["term", "entity"], "left_semi").select("row", "term")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of find_private's rows."""
    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in KINDS]
    spans = F.array_sort(F.concat("base", "terms"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with placeholders where base spans and disclosing terms were; a null text stays null.

    An empty text stays empty; rows that are the same are changed alike; an empty table gives an empty one; columns of any
    name but text are as they were."""
    rows, name = shared.numbered(docs)
    found = _found(rows, name)
    spans = F.array_sort(F.concat("base", "terms"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    mark = F.create_map(*(F.lit(x) for k, v in [*((k, v[2]) for k, v in KINDS.items()), ("term", TERM)] for x in (k, v)))
    body = F.col(name["text"]).cast("string")
    text = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(mark, s["kind"])).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    new = F.when(F.size(spans) > 0, text).otherwise(F.col(name["text"]))
    return found.withColumn(name["text"], new).select(*(F.col(name[c]).alias(c) for c in docs.columns))
