"""Secret scanning with a random forest that removes false positives.

Patterns find candidates; a forest on features of the candidate and of what
stands around it decides. Everything runs as DataFrame functions and Spark's own
forest. The forest learns from labelled findings; ``labelled_findings`` makes
such a set from a corpus: credentials and decoys of common kinds, set into
passages of sampled documents, besides ordinary long words that occur there.
"""
from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from lanewise.llm.common import saved

# Names of credentials, and words that stand near look-alikes
CREDENTIAL = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential|bearer"
DECOY = "commit|sha1|sha256|md5|checksum|digest|hash|etag|uuid|guid|revision|example|sample|placeholder|dummy|version|build"
PLACEHOLDER = "example|changeme|change_me|placeholder|your[_-]|dummy|sample|redacted|xxxx|test|1234567|0000000|aaaaaa|fixme|todo"

RUN = r"A-Za-z0-9_+/~\-"
# a name may go on before and after the credential's word; what a run may hold is part of it, so that no run swallows a name
NAME = rf"{RUN}."
ASSIGNED = rf"(?i:(?<![{NAME}])[{NAME}]*?(?:{CREDENTIAL})[{NAME}]{{0,200}}[\"']?\s{{0,3}}(?:=>|:=|[=:])\s{{0,3}}[\"']?)"
CANDIDATE = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
             rf"|{ASSIGNED}[^\s\"'<>]{{6,}}|(?<![{RUN}])[{RUN}]{{16,}}={{0,2}}")
AROUND = 48  # characters of context
TRUSTED = 0.5
SAMPLE = 600  # documents that labelled findings are made from
DICTIONARY = 20_000  # four-letter pieces of frequent words

FEATURES = ["length", "changes", "entropy", "digits", "upper", "hex", "covered", "known", "path", "assigned", "named", "decoy", "placeholder", "quoted"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, start, before, value, after): every match with its place (from 0) and what stands around it.

    ``row`` tells rows of equal id apart by their text. Equal rows give equal candidates, so they are reported once.
    """
    text = F.col(f"`{text_col}`").cast("string")
    d = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where(text.rlike(CANDIDATE))
    # the marks are single characters, so that places stay; a text's own are blanked for the search
    marked = F.regexp_replace(F.translate("text", "\x01\x02", "  "), f"({CANDIDATE})", "\x01$1\x02")
    parts = d.select("id", F.xxhash64("text").alias("row"), F.split(marked, "\x01").alias("parts"))
    lengths = F.transform("parts", lambda p: F.char_length(p) - F.when(F.instr(p, "\x02") > 0, 1).otherwise(0))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    unmarked = lambda p: F.replace(p, F.lit("\x02"), F.lit(""))
    parts = parts.select("id", "row", "parts", starts.alias("starts"), F.transform("parts", lambda p: F.right(unmarked(p), F.lit(AROUND))).alias("ends"),
                         F.transform("parts", lambda p: F.left(unmarked(p), F.lit(AROUND))).alias("heads"))
    # every part but the first holds a match of six or more characters, so these many parts reach as far as AROUND
    reach = AROUND // 6 + 1
    places = F.sequence(F.lit(2), F.size("parts"))
    each = parts.where(F.size("parts") > 1).select("id", "row", F.explode(F.transform(places, lambda k: F.struct(
        F.element_at("parts", k).alias("here"), F.element_at("starts", k).alias("start"),
        F.array_join(F.slice("ends", F.greatest(k - reach, F.lit(1)), F.least(k - 1, F.lit(reach))), "").alias("left"),
        F.array_join(F.slice("heads", k + 1, F.lit(reach)), "").alias("right")))).alias("x")).select("id", "row", "x.*")
    whole = F.split_part("here", F.lit("\x02"), F.lit(1))
    name = F.regexp_extract(whole, rf"^{ASSIGNED}", 0)
    out = each.select("id", "row", (F.col("start") + F.char_length(name)).alias("start"),
                      F.right(F.concat("left", name), F.lit(AROUND)).alias("before"),
                      F.substr(whole, F.char_length(name) + 1).alias("value"),
                      F.left(F.concat(F.split_part("here", F.lit("\x02"), F.lit(2)), "right"), F.lit(AROUND)).alias("after"))
    return out.where("value <> ''").distinct()


def sample_of(docs: DataFrame, id_col: str, text_col: str, count: int = SAMPLE) -> DataFrame:
    """(id, text) of at most ``count`` documents drawn by hash."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(count)
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    return d.join(F.broadcast(ids), "id", "left_semi")  # at most ``count`` ids


def pieces(word: str | Column) -> Column:
    w = F.col(word) if isinstance(word, str) else word
    return F.when(F.char_length(w) >= 4, F.transform(F.sequence(F.lit(1), F.char_length(w) - 3), lambda i: F.substr(w, i, F.lit(4))))


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece): the most frequent four-letter pieces of the words of all texts."""
    text = F.lower(F.col(f"`{text_col}`").cast("string"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}{4,})"), F.lit(1))).alias("w")).groupBy("w").count()
    return saved(words.select(F.explode(pieces("w")).alias("piece"), "count").groupBy("piece").agg(F.sum("count").alias("count"))
                 .orderBy(F.desc("count"), "piece").limit(DICTIONARY).select("piece"))


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the FEATURES of (before, value, after)."""
    v, size = F.col("value"), F.char_length("value").cast("double")
    count = lambda pattern: F.char_length(F.regexp_replace(v, pattern, "")).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = F.char_length(F.regexp_replace(kinds, r"(?s)(.)\1+", "$1")) - 1
    shares = F.transform(F.array_distinct(F.split(v, "")), lambda c: (size - F.char_length(F.replace(v, c, F.lit("")))) / size)
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    near = F.lower(F.concat("before", F.lit(" "), F.left("after", F.lit(12))))
    base = found.withColumns({
        "length": F.least(size, F.lit(200.0)), "changes": changes / size, "entropy": entropy,
        "digits": 1 - count("[0-9]") / size, "upper": 1 - count("[A-Z]") / size,
        "hex": v.rlike("^[0-9a-fA-F]+$").cast("double"),
        "known": v.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_\w{30,}|^xox[abpr]-|^eyJ\w+|^sk[_-]\w{16,}|^AIza|^glpat-|^-----BEGIN").cast("double"),
        "path": (v.rlike("/") & F.col("before").rlike(r"(://\S*|[./\\@])$") | v.rlike(r"/\w+/")).cast("double"),
        "assigned": F.col("before").rlike("[=:][\\s\"']*$").cast("double"),
        "named": near.rlike(f"({CREDENTIAL})[^a-z]{{0,12}}$|({CREDENTIAL})[{NAME}]{{0,40}}[^a-z]{{0,6}}[=:(]").cast("double"),
        "decoy": near.rlike(f"\\b({DECOY})\\b").cast("double"),
        "placeholder": F.lower(v).rlike(PLACEHOLDER).cast("double"),
        "quoted": F.col("before").rlike("[\"'`]$").cast("double")})
    # the share of four-letter pieces that the dictionary knows, over distinct values
    values = base.select("value").distinct()
    some = values.select("value", F.explode(F.array_distinct(pieces(F.lower("value")))).alias("piece"))
    share = some.join(F.broadcast(words.withColumn("yes", F.lit(1.0))), "piece", "left").groupBy("value").agg(  # at most DICTIONARY rows
        F.avg(F.coalesce("yes", F.lit(0.0))).alias("covered"))
    return base.join(share, "value", "left").fillna(0.0, ["covered"])


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(before, value, after, secret): made credentials and decoys in passages of sampled documents, and long words of theirs."""
    sample = saved(sample_of(docs, id_col, text_col))  # else the search for its candidates runs before the draw, over all texts
    seed = sample.select("id", F.explode(F.sequence(F.lit(0), F.lit(27))).alias("kind"), F.left("text", F.lit(4000)).alias("t")).withColumn(
        "h", F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.col("kind").cast("string")), 256))
    at = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("t") - 100, F.lit(1))).cast("int") + 1
    mixed = F.regexp_replace(F.concat(F.base64(F.unhex("h")), F.base64(F.unhex(F.reverse("h")))), "[+/=]", "k")
    cut = lambda c, n: F.left(c, F.lit(n))
    lower, upper, digit = F.col("h"), F.upper(mixed), F.right(F.translate("h", "abcdef", "123456"), F.lit(1))
    word = F.coalesce(F.nullif(F.regexp_extract(F.substr("t", at), r"\b([A-Za-z]{4,12})\b", 1), F.lit("")), F.lit("word"))
    # (text before, value, secret?)
    kinds = [("", F.concat(F.lit("AKIA"), cut(upper, 16)), 1), ("key ", F.concat(F.lit("AKIA"), cut(upper, 16)), 1),
             ("token = \"", cut(lower, 40), 1), ("token: ", cut(mixed, 32), 1), ("password=", cut(lower, 18), 1), ("password: ", cut(mixed, 12), 1),
             ("", F.concat(F.lit("ghp_"), cut(mixed, 36)), 1), ("api_key = '", cut(mixed, 40), 1), ("Bearer ", F.concat(F.lit("eyJ"), cut(mixed, 60)), 1),
             ("secret=", cut(mixed, 24), 1),
             ("DB_PASSWORD=", F.concat(cut(F.lower(word), 6), digit, F.lit("!"), cut(lower, 2)), 1),
             ("password: ", F.concat(cut(F.initcap(word), 5), F.lit("#"), cut(lower, 4)), 1),
             ("client_secret: '", F.concat(cut(mixed, 4), F.lit("$$"), cut(lower, 4)), 1), ("passwd=", F.concat(cut(mixed, 5), F.lit("@!"), digit), 1),
             ("commit ", cut(lower, 40), 0), ("md5: ", cut(lower, 32), 0), ("sha256 ", lower, 0),
             ("uuid ", F.regexp_replace(cut(lower, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), 0),
             ("password=", F.concat(F.lit("${"), F.upper(word), F.lit("}")), 0), ("password: ", F.concat(F.lower(word), F.lit("s.")), 0),
             ("token = ", F.concat(F.lower(word), F.lit("();")), 0), ("secret: ", F.concat(word, F.lit(",")), 0),
             ("password=", F.concat(F.lit("changeme_"), word), 0), ("api_key = \"", F.concat(F.lit("your-api-key-"), word), 0),
             ("key ", F.concat(F.lit("AKIA"), cut(upper, 9), F.lit("EXAMPLE")), 0),
             ("https://www.", F.concat(word, F.lit("/"), F.reverse(word), F.lit("/"), word, F.lit("_page")), 0),
             ("", F.translate(cut(lower, 16), "abcdef", "012345"), 0), ("", F.concat(word, F.initcap(word), F.lit("_"), F.reverse(word), F.lit("handler")), 0)]
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) if k != 1 else x[1] for x in kinds]), F.col("kind") + 1)
    made = seed.select(F.concat(F.right(F.substr("t", F.lit(1), at), F.lit(24)), F.lit(" "), pick(0)).alias("before"), pick(1).alias("value"),
                       F.left(F.concat(F.lit(" "), F.substr("t", at)), F.lit(AROUND)).alias("after"), pick(2).cast("double").alias("secret"))
    plain = candidates(sample, "id", "text").where(F.col("value").rlike("^[A-Za-z_-]+$")).select(
        "before", "value", "after", F.lit(0.0).alias("secret"))
    return made.unionByName(plain)


def train(findings: DataFrame, words: DataFrame) -> Model | None:
    """The forest for labelled findings (before, value, after, secret); None where there are no findings."""
    data = saved(featured(findings, words).select(*FEATURES, "secret"))
    if data.isEmpty():
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data)
    return RandomForestClassifier(labelCol="secret", numTrees=40, maxDepth=8, seed=5, subsamplingRate=0.8).fit(ready)


def scan(docs: DataFrame, model: Model | None, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = TRUSTED) -> DataFrame:
    """(id, row, start, length, value, score) of the candidates that the forest takes for secrets.

    Null and empty texts have none. Repeated rows of one id and text are reported once. ``start`` counts characters from 0. Without
    a model every candidate is reported with score null. Other columns are not read.
    """
    found = saved(candidates(docs, id_col, text_col))
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        rated = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(found, words)))
        scored = rated.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= least)
    return scored.select(F.col("id").alias(id_col), "row", "start", F.char_length("value").alias("length"), "value", "score")


def redact(docs: DataFrame, secrets: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found value replaced in its row's text, in the same columns; rows without findings pass as they are."""
    values = secrets.groupBy(F.col(id_col).alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("value").alias("__values"))
    longest = F.array_sort("__values", lambda a, b: F.char_length(b) - F.char_length(a))
    text = F.col(f"`{text_col}`")
    clean = F.aggregate(longest, text, lambda t, v: F.replace(t, v, F.lit(mark)))
    joined = docs.withColumn("__hash", F.xxhash64(text.cast("string"))).join(
        values, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__row")), "left")
    return joined.withColumn(text_col, F.when(F.col("__values").isNotNull(), clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
