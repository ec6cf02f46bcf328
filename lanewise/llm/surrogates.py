"""Surrogates for personal data.

Detected entities get replacements of their own kind and shape: digits for
digits, letters for letters, names of the same gender and script. A replacement
depends on the key and the entity alone, so an entity has the same one in every
document. Replacements that two entities share, or that are an entity of the
corpus themselves, are drawn again until all are distinct.
"""
from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lanewise.llm.common import saved, slices_of

# Given names by gender and script, forms of address by gender
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Laura Sofia Julia Clara Helena Marta Irene Alice Nora Paula Diana Eva Rosa Lucia Elena Sarah Mary Susan Linda Karen Sophie Marie Claire".split(),
    ("m", "latin"): "Paul Martin Jonas Lukas Daniel Thomas David Peter Robert Carlos Miguel Pablo Pierre Louis Henri James John Michael William Richard Hans Karl Antonio".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος".split(),
}
ADDRESS = {"m": "Mr Herr Monsieur Señor Sr Don г-н κ".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña г-жа κα".split(), "n": "Dr Prof".split()}
GENDER = {n.lower(): (g, s) for (g, s), names in GIVEN.items() for n in names}
PARTS = {"latin": ("Bar Dal Fen Gor Hal Kes Lan Mor Nel Ost Per Ran Sol Tar Vel Win Zan Ber Cor Dun".split(), "a e i o u".split(), "der den ner mann sen lin ton ker gard well".split()),
         "cyrillic": ("Бар Дал Гор Кес Лан Мор Нел Ост Пер Ран Сол Тар Вел Зан Бер Кор".split(), "а е и о".split(), "нов ков лин рин сон тов".split()),
         "greek": ("Βαρ Δαλ Γορ Κασ Λαν Μορ Νελ Περ Ραν Σολ Ταρ Βελ".split(), "α ε ι ο".split(), "ίδης άκης όπουλος άτος".split())}

_title = "|".join(t for ts in ADDRESS.values() for t in ts)
_given = "|".join(sorted({n for ns in GIVEN.values() for n in ns}, key=lambda n: (-len(n), n)))
CAP = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][\w'’-]+"
ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w+])[2-6](?:\d{12,18}|\d{3}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?!\w))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"
    rf"|(?P<name>(?<!\w)(?:(?P<title>{_title})\.? (?P<called>{CAP}(?: {CAP})?)|(?P<given>{_given}) (?P<family>{CAP}))(?!\w))")
# what every entity holds; the look at the first letter spares the names at most places
CUE = rf"[0-9@]|(?=[A-ZÀ-ÞΑ-ΩА-Ягκ])(?<!\w)(?:{_title}|{_given})\.? "


PATIENCE = 8  # draws of a value's own shape before a longer one


class Stream:
    """Numbers drawn from a key, an entity and the number of the draw."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.block, self.left = key, repr(what).encode(), 0, 0

    def below(self, n: int) -> int:
        """A number from 0 to n - 1; of 64 bits, so all but evenly spread."""
        out = hmac.new(self.key, self.what + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
        self.block += 1
        return int.from_bytes(out[:8], "big") % n

    def of(self, options: list[str]) -> str:
        return options[self.below(len(options))]


def script_of(word: str) -> str:
    c = word[:1]
    return "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "latin"


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10


def shaped(text: str, s: Stream, keep: int = 0) -> str:
    """Letters for letters, digits for digits, upper case for upper case; ``keep`` leading characters stay."""
    out = list(text[:keep])
    for c in text[keep:]:
        out.append(str(s.below(10)) if c.isdigit() else chr(97 + s.below(26)) if c.islower() else chr(65 + s.below(26)) if c.isupper() else c)
    return "".join(out)


def surrogate(kind: str, value: str, key: bytes, draw: int) -> str:
    """The replacement of a canonical value."""
    s = Stream(key, kind, value, draw)
    more = draw // PATIENCE  # a shape that the corpus fills is left: later draws are longer
    size = len(value)
    if kind in ("card", "phone", "iban", "ssn"):
        value += "0" * more
    if kind == "email":
        user, _, host = value.rpartition("@")
        name, _, top = host.rpartition(".")
        return f"{shaped(user + 'a' * more, s)}@{shaped(name, Stream(key, 'host', name))}.{top}"  # one host stays one host
    if kind == "ip":
        parts = [min(3, len(x) + more) for x in value.split(".")]
        three = 155 if more < 3 else 900  # more than 255 only where nothing else is left
        return ".".join(str(1 + s.below(9) if n == 1 else 10 + s.below(90) if n == 2 else 100 + s.below(three)) for n in parts)
    if kind == "card":
        out = shaped(value, s, 1)
        if luhn(value[:size]) == 0:  # a valid number stays valid
            out = next(out[:-1] + c for c in "0123456789" if luhn(out[:-1] + c) == 0)
        return out
    if kind == "phone":
        lead = size - 10 if size > 10 else 1
        return shaped(value, s, max(0, lead))
    if kind == "iban":
        return shaped(value, s, 2)
    if kind.startswith("given"):
        _, gender, script = kind.split(":")
        names = GIVEN[gender, script] if gender != "n" else GIVEN["f", script] + GIVEN["m", script]
        return "-".join(s.of(names) for _ in range(1 + draw // 2))  # more parts when single names run out
    if kind.startswith("family"):
        first, vowels, last = PARTS[kind.split(":")[1]]
        return s.of(first) + "".join(s.of(vowels) + s.of(first).lower() for _ in range(draw // 2)) + s.of(vowels) + s.of(last)
    return shaped(value, s)


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value). A name gives an entity for each part."""
    for m in ENTITY.finditer(text):
        kind = m.lastgroup if m.lastgroup in ("email", "iban", "ip", "ssn", "card", "phone") else "name"
        if kind != "name":
            raw = m[0]
            if kind == "card" and luhn(re.sub(r"\D", "", raw)):
                continue  # no card number
            yield m.start(), m.end(), kind, (raw.lower() if kind == "email" else raw if kind == "ip" else re.sub(r"\W", "", raw))
            continue
        if m["title"]:
            words = m["called"].split(" ")
            at = m.start("called")
            gender = next(g for g, ts in ADDRESS.items() if m["title"] in ts)
            known = GENDER.get(words[0].lower()) if len(words) == 2 else None
            gender = known[0] if known and gender == "n" else gender
        else:
            words, at, gender = [m["given"], m["family"]], m.start("given"), GENDER[m["given"].lower()][0]
        if len(words) == 2:
            yield at, at + len(words[0]), f"given:{gender}:{script_of(words[0])}", words[0].lower()
            at += len(words[0]) + 1
        yield at, at + len(words[-1]), f"family:{script_of(words[-1])}", words[-1].lower()


def written(raw: str, kind: str, new: str) -> str:
    """``new`` with the punctuation and the case of ``raw``."""
    if kind in ("phone", "card", "iban", "ssn"):
        fill = iter(new)
        return "".join([*(next(fill, c) if c.isalnum() else c for c in raw), *fill])
    if kind.startswith(("given", "family")) and raw.isupper() and len(raw) > 1:
        return new.upper()
    if kind == "email" and any(c.isupper() for c in raw):
        return "".join(n.upper() if r.isupper() else n for r, n in zip(raw.ljust(len(new)), new))
    return new


def replaced(text: str, names: dict[tuple[str, str], str]) -> tuple[str, list[dict]]:
    """The text with all entities replaced, and their spans in the old text."""
    out, done, spans = [], 0, []
    for start, end, kind, value in entities(text):
        new = written(text[start:end], kind, names[kind, value])
        out += [text[done:start], new]
        spans.append({"start": start, "end": end, "kind": kind, "surrogate": new})
        done = end
    return "".join([*out, text[done:]]), spans


def per_text(found: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices_of(whole, "text") if "text" in whole.schema.names else [whole]:
                yield run(b)
    return found.mapInArrow(each, schema)


def assign(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) with distinct surrogates, none of them a value of its kind.

    Of values that share a surrogate the smallest keeps it, the others draw again; so do those that drew another's value.
    """
    def draw(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(b.column(c).to_pylist() for c in ("kind", "value", "draw")))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array((surrogate(k, v, key, d) for k, v, d in rows), pa.string())],
                                          names=[*b.schema.names, "surrogate"])

    schema = "kind string, value string, draw int, surrogate string"
    todo, settled = values.select("kind", "value", F.lit(0).alias("draw")), None
    taken = values.select("kind", F.col("value").alias("low"))
    while True:
        drawn = saved(per_text(todo, draw, schema)).withColumn("low", F.lower("surrogate"))
        first = F.row_number().over(Window.partitionBy("kind", "low").orderBy("value"))
        free = saved(drawn.withColumn("r", first).join(taken.withColumn("own", F.lit(True)), ["kind", "low"], "left")
                     .select("kind", "value", "draw", "surrogate", ((F.col("r") == 1) & F.col("own").isNull()).alias("good")))
        good = free.where("good").select("kind", "value", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        if free.where("NOT good").isEmpty():
            return settled
        taken = values.select("kind", F.col("value").alias("low")).unionByName(settled.select("kind", F.lower("surrogate").alias("low"))).distinct()
        todo = free.where("NOT good").select("kind", "value", (F.col("draw") + 1).alias("draw"))


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): every row's whole text with surrogates, and the spans (start, end, kind, surrogate) of the old text.

    Null and empty texts stay as they are with no spans; repeated rows are treated alike and each kept; other columns are not read.
    Names are known by a form of address or a common given name before them; of two entities in one place the one whose pattern is named
    first in ENTITY counts. Only texts that may hold an entity are shuffled.
    """
    kind_of = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    may = F.coalesce(F.col("text").rlike(CUE), F.lit(False))

    def detect(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(h, k, v) for h, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist())
                for k, v in {(k, v) for _, _, k, v in entities(t)}]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                                          names=["row", "kind", "value"])

    row = F.unhex(F.md5("text"))  # equal texts hold equal entities
    found = saved(per_text(d.where(may).select(row.alias("row"), "text"), detect, "row binary, kind string, value string").distinct())
    names = assign(found.select("kind", "value").distinct(), key)
    # entities are met by many rows; a very common one is split by adaptive skew handling, as no later step needs its key
    lists = found.join(names, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("names"))

    def replace(b: pa.RecordBatch) -> pa.RecordBatch:
        done = [replaced(t, {(n["kind"], n["value"]): n["surrogate"] for n in ns}) if ns else (t, [])
                for t, ns in zip(b.column("text").to_pylist(), b.column("names").to_pylist())]
        spans = pa.array([x[1] for x in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())])))
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array([x[0] for x in done], pa.string()), spans], names=["id", "text", "spans"])

    spans_type = "array<struct<start:int,end:int,kind:string,surrogate:string>>"
    hit = d.where(may).withColumn("row", row).join(lists, "row", "left").select("id", "text", "names")
    changed = per_text(hit, replace, f"id {kind_of}, text string, spans {spans_type}")
    same = d.where(~may).select("id", "text", F.array().cast(spans_type).alias("spans"))
    return changed.unionByName(same).withColumnsRenamed({"id": id_col, "text": text_col})
