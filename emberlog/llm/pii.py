"""Personal data by bootstrapped contextual extraction.

Fixed expressions find e-mail addresses, network addresses, card and phone numbers. Tokens that these spans
find are seeds, however many words they have; the word before a token, the word after it, and both together are its
lexical patterns, whatever the token looks like. Patterns and the tokens found in them form a graph that is scored in rounds: a pattern is as
trusted as the tokens it holds (all of them, seeds or not), a token as its best pattern. Tokens in highly trusted
patterns become spans too.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.once import once
from emberlog.llm.frames import let
from emberlog.session import stage

KINDS = ("email", "ip", "card", "phone", "learned")
#: A match starts at the start of its run, or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
#: Whole runs of 16 to 19 digits with single separators.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words that may be identifiers: six characters or more, with a digit, an at sign, or a dot, hyphen or underscore
#: between two other characters.
#: Numbers in two or more groups of under six characters, parted by single blanks, are one identifier.
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D])(?:(?=[^\x20\x09-\x0D0-9@]*+[0-9@]|[A-Za-z]++[._-][A-Za-z])[^\x20\x09-\x0D]{6,}+"
    r"|(?=[0-9()+.\x20-]{6})[(+]?[0-9][0-9().-]{0,4}+(?:\x20[(+]?[0-9][0-9().-]{0,4}+(?![^\x20\x09-\x0D]))++)"
)

#: Characters on each side of a candidate in which its neighbouring word is looked for.
CONTEXT = 48
ROUNDS = 3
#: A pattern is trusted from this share of trusted tokens, and this many different ones.
TRUST = 0.9
SUPPORT = 10
BLOCK = 128
#: Longest token, in characters, whose text enters the graph; longer ones are known by their hash.
TOKEN_CHARS = 64


def _before(steps: Column) -> Column:
    """Sum of all earlier elements, per element; two levels, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")

    def add(a: Column, x: Column) -> Column:
        return a + x

    def with_blocks(s: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(s, b * BLOCK + 1, BLOCK), zero, add),
        )
        return let(
            blocks,
            lambda sums: F.transform(
                s,
                lambda _, i: F.aggregate(F.slice(sums, 1, F.floor(i / BLOCK).cast("int")), zero, add)
                + F.aggregate(F.slice(s, (i - i % BLOCK) + 1, i % BLOCK), zero, add),
            ),
        )

    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(let(steps, with_blocks))


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """start, end, hit of the leftmost non-overlapping matches; with ``context``, also the text around.

    That text goes on over one neighbouring match on each side, so a match may be the other's neighbour.

    The text between matches comes from splitting by the same expression, so the lengths of both add up to
    positions in code points.
    """

    def placed(gaps: Column) -> Column:
        def with_hits(hits: Column) -> Column:
            gap = F.transform(gaps, lambda g: F.length(g).cast("long"))
            steps = F.transform(hits, lambda h, i: F.get(gap, i) + F.length(h))

            def build(before: Column) -> Column:
                def one(hit: Column, i: Column) -> Column:
                    start = F.get(before, i) + F.length(F.get(gaps, i))
                    fields = [start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit")]
                    if context:
                        n, none = F.lit(context), F.lit("")
                        left = [F.right(F.get(gaps, i - 1), n), F.get(hits, i - 1)]
                        right = [F.get(hits, i + 1), F.left(F.get(gaps, i + 2), n)]
                        left = [*[F.coalesce(x, none) for x in left], F.right(F.get(gaps, i), n)]
                        right = [F.left(F.get(gaps, i + 1), n), *[F.coalesce(x, none) for x in right]]
                        fields += [F.right(F.concat(*left), n).alias("left"), F.left(F.concat(*right), n).alias("right")]
                    return F.struct(*fields)

                return F.transform(hits, one)

            return let(_before(steps), build)

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_hits)

    empty = "array<struct<start:bigint,end:bigint,hit:string" + (",left:string,right:string>>" if context else ">>")
    found = let(F.split(text, pattern, -1), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(empty))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    values = F.transform(F.sequence(F.lit(1), F.length(digits)), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_matches(text: Column) -> Column:
    """start, end, hit, left, right, kind (index in KINDS) of the fixed expressions' matches, by kind, then start."""

    def digits(hit: Column) -> Column:
        return F.regexp_replace(hit, "[^0-9]", "")

    def of(kind: int, pattern: str, good) -> Column:
        found = F.filter(matches(text, pattern, CONTEXT), lambda m: good(m["hit"]))
        return F.transform(found, lambda m: F.struct(*[m[k].alias(k) for k in fields], F.lit(kind).alias("kind")))

    fields = ("start", "end", "hit", "left", "right")
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,left:string,right:string,kind:int>>")
    email = F.when(F.contains(text, F.lit("@")), of(0, EMAIL, lambda h: F.lit(True))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), of(3, PHONE, lambda h: F.length(digits(h)).between(8, 15))).otherwise(none)
    return F.concat(email, of(1, IP, lambda h: h.rlike(IP_PARTS)), of(2, CARD, lambda h: luhn(digits(h))), phone)


def bare(token: Column) -> Column:
    """A token without the punctuation around it."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")


def lexical_patterns(left: Column, right: Column) -> Column:
    """The patterns of the words around a token: left, right, both; a side without a word gives none."""
    sides = F.array(
        F.when(left != "", F.concat(F.lit("L "), left)),
        F.when(right != "", F.concat(F.lit("R "), right)),
        F.when((left != "") & (right != ""), F.concat(F.lit("B "), left, F.lit(" "), right)),
    )
    return F.array_compact(sides)


def _candidates(docs: DataFrame) -> DataFrame:
    """docs' columns but the text, _row, _spans, and _tokens: start, end, token, patterns, seed.

    Tokens are the base spans (seeds) and the candidates that no base span touches. Neighbours are whole words
    beside the words that a token touches, so what is glued to a span is no neighbour.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("_text", text).withColumns(
        {"_base": base_matches(F.col("_text")), "_found": matches(F.col("_text"), CANDIDATE, CONTEXT)}
    )
    found = once(found, "_base", "_found").drop("text", "_text")

    def described(m: Column, seed: bool) -> Column:
        left = F.lower(F.regexp_extract(m["left"], r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D]*$", 1))
        right = F.lower(F.regexp_extract(m["right"], r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1))
        token = bare(F.when(F.length(m["hit"]) <= TOKEN_CHARS, m["hit"]).otherwise(F.sha2(m["hit"], 256)))
        patterns = lexical_patterns(left, right)
        return F.struct(m["start"], m["end"], token.alias("token"), patterns.alias("patterns"), F.lit(seed).alias("seed"))

    def free(m: Column) -> Column:
        return ~F.exists("_base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))

    seeds = F.transform("_base", lambda m: described(m, True))
    others = F.transform(F.filter("_found", free), lambda m: described(m, False))
    spans = F.transform("_base", lambda m: F.struct(m["start"], m["end"], m["kind"]))
    return stage(
        found.withColumns({"_tokens": F.concat(seeds, others), "_spans": spans}).drop("_found", "_base")
        .withColumn("_row", F.monotonically_increasing_id()),
        "identifiers",
    )


def trusted_patterns(tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, trust of the patterns that reach TRUST and SUPPORT, from (pattern, token, seed) rows.

    Each token counts once per pattern, so frequent tokens weigh no more than others; the pairs are
    combined before they are shuffled. A token is a seed if it is one anywhere.
    """
    edges = stage(tokens.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "pattern-edges")
    seeds = edges.filter("seed").select("token").distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    for k in range(rounds):
        weighed = edges.join(scores, "token", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        trust = F.sum("score") / (F.count(F.lit(1)) + 1.0)
        patterns = weighed.groupBy("pattern").agg(trust.alias("trust"), F.sum("score").alias("support"))
        patterns = stage(patterns.filter((F.col("trust") >= TRUST) & (F.col("support") >= SUPPORT)), "patterns")
        if k < rounds - 1:
            learned = edges.join(patterns, "pattern").groupBy("token").agg(F.max("trust").alias("score"))
            both = seeds.unionByName(learned).groupBy("token").agg(F.max("score").alias("score"))
            scores = stage(both, "token-scores")
    return patterns.select("pattern", "trust")


def private_spans(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` without ``text``, and ``_spans``: start, end, kind (index in KINDS).

    Positions are code points, ends exclusive; order: kind, then start. Null text is empty; rows equal in text
    get equal spans; an empty table gives an empty result.
    """
    found = _candidates(docs)
    seen = found.select("_row", F.inline("_tokens"))
    pairs = seen.select(F.explode("patterns").alias("pattern"), "token", "seed")
    patterns = trusted_patterns(pairs)
    open_ = seen.filter("not seed").select("_row", "start", "end", F.explode("patterns").alias("pattern"))
    learned = (
        open_.join(patterns, "pattern", "left_semi").select("_row", "start", "end").distinct()
        .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_new"))
        .withColumn("_new", F.transform("_new", lambda s: F.struct(s["start"], s["end"], F.lit(4).alias("kind"))))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    joined = found.join(learned, "_row", "left").withColumn("_spans", F.concat("_spans", F.coalesce("_new", none)))
    return joined.drop("_tokens", "_new", "_row")


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(parts, ",")


def private_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, digest of the base spans and all spans of every document."""
    spans = F.col("_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] < 4)
    return private_spans(docs.select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"),
        count(4).alias("n_learned"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"),
    )
