"""Secret scans with corpus-wide ownership frequency (native: DataFrame functions only).

Every candidate value is hashed; hashes are aggregated by distinct owners, repositories and texts. A value that several
owners hold, or very many different texts of one owner, is a copied example; a value that few hold and that looks random
may be live. Values of the base patterns are always reported, values of the wider patterns only where they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm._shared import fresh, read_table, settle

# Kind, pattern, least length and the group it counts in; the first three are the base.
PATTERNS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"(AKIA[A-Z0-9]+)", 20, 1),
    ("hex", r"([0-9a-f]{24,})", 24, 1),
    ("vendor", r"((?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-|AIza|eyJ)[A-Za-z0-9_.-]{16,})", 20, 1),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+)", 40, 1),
    ("blob", r"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,})", 32, 1),
]
BASE = 3  # how many of them are the base

COPIED_OWNERS = 3  # a value of so many owners is an example
COPIED_REPOSITORIES = 5  # and so is one of so many repositories, however few their owners
COPIED_TEXTS = 20  # and so is one in so many different texts, even of one repository
MIN_DISTINCT = 10  # characters that a random value without name or format has at least, with a digit
MIN_LETTERS = 20  # the same for one of letters only, in both cases
MIN_FORMAT = 7  # the same for hexadecimal digits, and for values whose format says what they are
LONG = 20  # characters of a named key's value that count
NEXT = 3  # characters after a match that are looked at
PLAIN_WORDS = r"^[A-Za-z]?[a-z]+(?:[-/.][a-z]+)*\.?$"  # a value that may be ordinary words
GOES_ON = r"^[,;:]?\x20[a-z]"  # how a sentence goes on after it
BLOCK = 4096  # characters of a text that are masked together
RUN = r"([A-Za-z0-9+/_.=-]{6,})"  # where other occurrences of values are looked for
KIND = {name: k for k, (name, *_) in enumerate(PATTERNS)}
MARK, NO_MARK = "\x01", "\x02"


# What a text must hold before a pattern is tried at all: one of some words in lower case, or a long run and a word.
_RUN = r"[A-Za-z0-9+/_.-]{20}"
_NAMES = ("password", "passwd", "secret", "token", "api")
_FORMATS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live_", "glpat-", "AIza", "eyJ")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _gates(text: Column, run: Column) -> dict[str, Column]:
    """For each kind a cheap test that no text with a match fails; ``run``: does the text hold _RUN?"""
    return {
        "assign": _holds(F.lower(text), _NAMES), "access": run & _holds(text, ("AKIA",)), "hex": run, "vendor": run & _holds(text, _FORMATS),
        "pem": _holds(text, ("-----BEGIN ",)), "blob": run,
    }


def _pieces(text: Column, pattern: str, gate: Column) -> Column:
    """array(struct(len, hit, head)): the text cut at the matches; every second piece is a match. Null without any.

    ``head`` holds the first characters of what stands between matches.

    Matches are set off by U+0001; U+0001 in the text is read as U+0002, which no pattern can match either, so
    places stay the same.
    """
    cut = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    piece = lambda p, i: F.struct(
        F.length(p).cast("long").alias("len"), F.when(i % 2 == 1, p).alias("hit"), F.when(i % 2 == 0, F.left(p, F.lit(NEXT))).alias("head")
    )
    return F.when(gate & text.rlike(pattern), F.transform(cut, piece))


def cut_texts(docs: DataFrame, row_id: str, text_column: str, keep: list[str]) -> DataFrame:
    """``row_id``, ``keep`` and ``kinds``, the pieces of each kind that matches: all that is needed of the texts, in one scan."""
    text = F.translate(F.coalesce(F.col(text_column), F.lit("")), MARK, NO_MARK)
    read = docs.select(row_id, *keep, text.alias("text"), text.rlike(_RUN).alias("run"))
    gates = _gates(F.col("text"), F.col("run"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), _pieces(F.col("text"), p, gates[name]).alias("pieces")) for k, (name, p, *_) in enumerate(PATTERNS)))
    return read.select(row_id, *keep, F.filter(kinds, lambda x: x["pieces"].isNotNull()).alias("kinds"))


def find_candidates(cut: DataFrame, row_id: str, keep: list[str]) -> DataFrame:
    """(row_id, kind, start, end, value, prose) and the columns of ``keep``: all matches of all patterns in ``cut_texts``.

    ``prose``: the value follows a colon, looks like words, and the sentence goes on after it. Places are code points, ends exclusive. Running sums over a text's pieces give them, so a text with very many
    matches costs no more than its length.
    """
    cut = (
        cut.select(row_id, *keep, F.explode("kinds").alias("k"))
        .select(row_id, *keep, "k.kind", F.posexplode("k.pieces").alias("at", "piece"))
        .select(row_id, *keep, "kind", "at", "piece.len", "piece.hit", "piece.head")
    )
    within = Window.partitionBy(row_id, "kind").orderBy("at")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = cut.withColumns({"end": F.sum("len").over(upto), "next": F.lead("head").over(within)}).where("hit is not null")
    value = F.coalesce(*(F.when(F.col("kind") == k, F.regexp_extract("hit", p, g)) for k, (_, p, _, g) in enumerate(PATTERNS)))
    least = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, (_, _, n, _) in enumerate(PATTERNS)))
    before = F.left("hit", F.length("hit") - F.length("value"))
    prose = (F.col("kind") == KIND["assign"]) & before.rlike(r":\x20*$") & F.col("value").rlike(PLAIN_WORDS) & F.coalesce("next", F.lit("")).rlike(GOES_ON)
    return (
        hits.withColumn("value", value)
        .where(F.length("value") >= least)
        .select(row_id, *keep, "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value", prose.alias("prose"))  # a value ends where its match ends
    )


def ownership(candidates: DataFrame, value_hash: str, owner: str, repository: str, page: str) -> DataFrame:
    """One row per value: how many owners, repositories and different texts hold it. Every step combines before its shuffle."""
    return (
        candidates.select(value_hash, owner, repository, page).distinct()
        .groupBy(value_hash, owner, repository)
        .agg(F.count("*").alias("n_texts"))
        .groupBy(value_hash, owner)
        .agg(F.count("*").alias("n_repositories"), F.sum("n_texts").alias("n_texts"))
        .groupBy(value_hash)
        .agg(
            F.count("*").alias("n_owners"),
            F.sum("n_repositories").alias("n_repositories"),
            F.sum("n_texts").alias("n_texts"),
        )
    )


def is_strong(kind: Column, value: Column) -> Column:
    """Whether a live value says what it is wherever it stands: it has a format, or holds both letters and digits."""
    return (kind != KIND["assign"]) | (value.rlike("[0-9]") & value.rlike("[A-Za-z]"))


def looks_live(kind: Column, value: Column) -> Column:
    """Whether a value looks random for its kind.

    The name before it speaks for an ``assign`` value, so half its characters (of the first LONG in number) being
    distinct is enough; ``hex``, ``access`` and ``vendor`` values need MIN_FORMAT distinct ones, ``pem`` none. Only
    ``blob`` has neither name nor format: MIN_DISTINCT with a digit, or MIN_LETTERS in both cases.
    """
    distinct = F.size(F.array_distinct(F.split(value, "")))
    loose = ((distinct >= MIN_DISTINCT) & value.rlike("[0-9]")) | ((distinct >= MIN_LETTERS) & value.rlike("^[A-Za-z]+$") & value.rlike("[A-Z]") & value.rlike("[a-z]"))
    return (
        F.when(kind == KIND["assign"], distinct * 2 >= F.least(F.length(value), F.lit(LONG)))
        .when(kind.isin(KIND["hex"], KIND["access"], KIND["vendor"]), distinct >= MIN_FORMAT)
        .when(kind == KIND["pem"], F.lit(True))
        .otherwise(loose)
    )


def judged_candidates(cut: DataFrame, row_id: str, owner: str, repository: str, page: str) -> DataFrame:
    """All candidates of ``cut_texts``, each with its value's ownership and verdict.

    Verdicts: ``copied`` (COPIED_OWNERS owners, COPIED_REPOSITORIES repositories or COPIED_TEXTS different texts, told
    apart by ``page``, or more), ``live`` (fewer, no prose and ``looks_live``), else ``weak``. Null owners count as one
    owner; copies of one text count once.
    """
    places = find_candidates(cut, row_id, [owner, repository, page])
    found = settle(places.withColumn("value_hash", F.sha2("value", 256)), "secrets")
    held = ownership(found, "value_hash", owner, repository, page)
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES) | (F.col("n_texts") >= COPIED_TEXTS)
    verdict = (
        F.when(copied, "copied")
        .when(~F.col("prose") & looks_live(F.col("kind"), F.col("value")), "live")
        .otherwise("weak")
    )
    return found.join(held, "value_hash").withColumn("verdict", verdict)


def owner_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def repository_of() -> Column:
    return F.concat_ws("/", owner_of(), F.coalesce(F.col("lang").cast("string"), F.lit("")))


def spans_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in PATTERNS))
    text = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Base spans, digest and all reported spans of every document.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied. Null and empty texts have no
    spans (digest of the empty string); repeated rows are scanned each by themselves; an empty table gives no rows.
    The owner is the document's source, the repository its source and language. Other columns are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", owner_of().alias("owner"), repository_of().alias("repository"), F.xxhash64("text").alias("page"),
    )
    cut = settle(cut_texts(rows, "row", "text", ["doc_id", "owner", "repository", "page"]), "pieces")
    judged = judged_candidates(cut, "row", "owner", "repository", "page")
    span = F.struct("start", "kind", "end", "verdict")
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"))
    out = cut.select("row", "doc_id").join(per_row, "row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string>>"))
    out = out.withColumn("all", every)
    base = F.filter("all", lambda s: s["kind"] < BASE)
    kept = F.filter("all", lambda s: (s["kind"] < BASE) | (s["verdict"] == "live"))
    count = lambda test: F.size(F.filter("all", test)).cast("long")
    return out.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(kept).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "copied").alias("n_copied"),
    )


def covered_stretches(spans: DataFrame) -> DataFrame:
    """(row, start, end): stretches that the row's spans (row, start, end) cover, those that touch as one."""
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > before, F.lit(True)).cast("long")
    numbered = spans.withColumn("begins", begins).withColumn("k", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def stretches_by_block(stretches: DataFrame) -> DataFrame:
    """(row, blocks): a map from blocks of BLOCK characters to their stretches (from, to, begins: put a mask there)."""
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    cut = stretches.where("end > start").select("row", "start", "end", block.alias("block"))
    low = F.col("block") * BLOCK
    part = F.struct(
        F.greatest(F.col("start") - low, F.lit(0)).cast("int").alias("from"), F.least(F.col("end") - low, F.lit(BLOCK)).cast("int").alias("to"), (F.col("start") >= low).alias("begins")
    )
    return cut.select("row", "block", part.alias("part")).groupBy("row", "block").agg(F.array_sort(F.collect_list("part")).alias("parts")).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), "parts"))).alias("blocks")
    )


def masked_text(text: Column, blocks: Column, mask: str) -> Column:
    """The text with its stretches masked, block by block: a block's cost does not depend on what stands elsewhere."""

    def fill(piece: Column, parts: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
        step = lambda acc, p: F.struct(
            F.concat(acc["done"], F.substring(piece, acc["at"] + 1, p["from"] - acc["at"]), F.when(p["begins"], F.lit(mask)).otherwise("")).alias("done"), p["to"].alias("at")
        )
        return F.aggregate(parts, start, step, lambda acc: F.concat(acc["done"], F.substring(piece, acc["at"] + 1, F.lit(BLOCK))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p, i: F.coalesce(fill(p, F.try_element_at(blocks, i)), p)), "")


def other_places(rows: DataFrame, live: DataFrame) -> DataFrame:
    """(row, start, end) where strong values of ``live`` stand in their row once more: as a whole run of letters, digits
    and signs, as one without the signs around it, or between two of its signs ``= . / +``."""
    strong = live.where(is_strong(F.col("kind"), F.col("value"))).select("row", F.col("value").alias("token")).distinct()
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, NO_MARK)
    cut = rows.join(strong.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(_pieces(text, RUN, F.lit(True))).alias("at", "piece"))
    upto = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = cut.select("row", "at", "piece.len", "piece.hit").withColumn("end", F.sum("len").over(upto)).where("hit is not null")
    lead = F.length(F.regexp_extract("hit", r"^([._=+/-]*)", 1))
    core = F.struct(lead.alias("at"), F.regexp_extract("hit", r"^[._=+/-]*(.*?)[._=+/-]*$", 1).alias("token"))
    pieces = F.split("hit", r"[=./+]")
    place = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, x: a + F.length(x) + 1)
    parts = F.filter(F.transform(pieces, lambda x, i: F.struct(place(i).alias("at"), x.alias("token"))), lambda x: F.length(x["token"]) >= 6)
    forms = F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col("hit").alias("token")), core), parts))
    told = runs.select("row", (F.col("end") - F.col("len")).alias("begin"), F.explode(forms).alias("form")).select("row", "begin", "form.at", "form.token")
    return told.join(strong, ["row", "token"]).select("row", (F.col("begin") + F.col("at")).alias("start"), (F.col("begin") + F.col("at") + F.length("token")).alias("end"))


def mask_live(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs``, all columns as they are, with their live-looking values masked; n_chars follows the text.

    Masked are the values' spans, and the places where values that are strong by themselves (``is_strong``) stand again
    in the same text (``other_places``); stretches that touch get one mask. All places are found in the text as it is,
    so no mask is looked into. Texts in which no pattern can match pass as they are; only the others are joined to
    their places, by two hashes of the row's id, text, source and language, so rows that repeat all four are judged
    once and masked alike.
    """
    key, blocks = fresh(docs, "key", "blocks")
    text = F.coalesce(F.col("text"), F.lit(""))
    gates = _gates(text, text.rlike(_RUN))
    gate = gates["assign"] | gates["pem"] | gates["hex"]  # the others need a run as well
    whole = F.struct(F.xxhash64("doc_id", "text", "source", "lang").alias("a"), F.xxhash64("lang", "source", "text", "doc_id", F.lit(1)).alias("b"))
    suspect = docs.where(gate).withColumn(key, whole)
    rows = suspect.select(F.col(key).alias("row"), "text", owner_of().alias("owner"), repository_of().alias("repository"), F.xxhash64("text").alias("page"))
    cut = settle(cut_texts(rows, "row", "text", ["owner", "repository", "page"]).where("size(kinds) > 0").dropDuplicates(["row"]), "pieces")
    live = settle(judged_candidates(cut, "row", "owner", "repository", "page").where("verdict = 'live'").select("row", "kind", "end", "value"), "live")
    spans = live.select("row", (F.col("end") - F.length("value")).alias("start"), "end")
    others = other_places(rows.select("row", "text").dropDuplicates(["row"]), live)
    found = stretches_by_block(covered_stretches(spans.union(others).distinct()))
    masked = suspect.join(found.toDF(key, blocks), key, "left")
    masked = masked.withColumn("text", F.when(F.col(blocks).isNull(), F.col("text")).otherwise(masked_text(F.col("text"), F.col(blocks), mask)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col(blocks).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return docs.where(~gate).select(*docs.columns).unionByName(masked.select(*docs.columns))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
