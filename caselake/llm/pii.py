"""Surrogates for personal data: keyed, type-consistent, distinct, and the same wherever an entity recurs.

Entities are found by pattern and named by a canonical form (an address in lower case, a number's
digits, each word of a titled name), so every way of writing one entity gets the same surrogate.
A surrogate is drawn from a keyed hash of type, canonical form and attempt:

* numbers keep their layout, phones their country code, cards their first digit and whether their
  check digit is right, bank accounts their country and whether their check digits are right, network
  addresses their four groups and whether they are public, private, local or of a link;
* e-mail addresses keep their structure and endings; a host recurs as one host;
* secrets keep their alphabet and length;
* names keep title, gender (from the title), script and capitals.

A surrogate is taken only if no entity of its type really has it and no other entity has drawn it;
of several that draw the same one the smallest canonical form keeps it, the others draw again until
none is left. So distinct entities stay distinct over the whole table. No format runs out: names, mails
and hosts grow every fourth attempt, numbers and secrets by a digit every ``GROW`` attempts, beyond their
layout once its values are taken; network addresses leave their range then, but stay addresses.

Entities are grouped before they are shuffled. Texts that cannot hold an entity, by a plain filter
inside the scan, never move; the others meet their replacements once.

Defined results: null and empty texts stay as they are; equal rows get equal texts, also under a
null doc_id; an empty table gives an empty result; all other columns stay untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from caselake.llm.arrow import map_rows, released, unused
from caselake.session import materialise

KEY = b"surrogates"
GROW = 16
# Titles before a name and the gender they tell (f, m, or n for either).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Señor": "m",
          "Señora": "f", "Sr": "m", "Sra": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
          "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
NAME = re.compile(r"\b(" + "|".join(TITLES) + r")(?:\.\s?|\s)((?:[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+)?)(?:\s[^\W\d_a-zß-öø-ÿ][^\W\d_]+){0,2})")
EMAIL = re.compile(r"[\w+-]+(?:\.[\w+-]+)*@([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])*\.[A-Za-z]{2,63})")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", re.ASCII)
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w)", re.ASCII)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
CARD = re.compile(r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])", re.ASCII)
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", re.ASCII)
SECRET = re.compile(r"(?i)\b(?:api[_-]?key|key|token|secret|password|passwd|pwd)\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{12,})")
HEX = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,}(?![0-9A-Za-z])")
# Whatever any of the patterns above can match has one of these; read by the scan, whose \s is ASCII alone.
MAYBE = (r"@|\d[\d ().-]{5}|\d\.\d{1,3}\.\d|[A-Z]{2}\d{2}|(?iu:key|token|secret|passw|pwd)|[0-9a-f]{32}|(?:"
         + "|".join(TITLES) + r")[.\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ENTITY = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()),
                               StructField("kind", StringType()), StructField("canonical", StringType())]))
# Consonants and vowels that names are made of, by script.
LETTERS = {"latin": ("bdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστ", "αεηιο")}


def script_of(word: str) -> str:
    c = ord(word[0])
    return "greek" if 0x370 <= c < 0x400 else "cyrillic" if 0x400 <= c < 0x530 else "latin"


def digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_digits(country: str, account: str) -> str:
    """The two digits that make country, digits and account leave 1 modulo 97, letters read as 10 to 35."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def network(groups: list[str]) -> str:
    """The special range an address lies in, if any: private, of the host itself or of the link."""
    first, second = int(groups[0]), int(groups[1])
    if first in (10, 127):
        return str(first)
    if (first, second) in ((192, 168), (169, 254)):
        return f"{first}.{second}"
    return "172.16" if first == 172 and 16 <= second < 32 else ""


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, none overlapping, in order."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            host = m[1].lower()
            found += [(m.start(), m.start(1) - 1, "mail", m[0].lower()), (m.start(1), m.end(1), "host", host)]
    for m in SECRET.finditer(text):
        if any(c.isdigit() for c in m[1]):
            found.append((m.start(1), m.end(1), "secret", m[1]))
    found += [(m.start(), m.end(), "secret", m[0]) for m in HEX.finditer(text)]
    found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text) if len(digits(m[0])) >= 8]
    found += [(m.start(), m.end(), "ip", m[0]) for m in IPV4.finditer(text)]
    found += [(m.start(), m.end(), "ssn", digits(m[0])) for m in SSN.finditer(text)]
    found += [(m.start(), m.end(), "card", digits(m[0])) for m in CARD.finditer(text)]
    for m in PHONE.finditer(text):
        if 8 <= len(digits(m[0])) <= 15:
            country = re.match(r"\+\d{1,3}", m[0])
            found.append((m.start(), m.end(), "phone", f"{country[0] if country else ''}/{digits(m[0][len(country[0]):] if country else m[0])}"))
    for m in NAME.finditer(text):
        gender, words = TITLES[m[1]], list(re.finditer(r"\S+", m[2]))
        for i, w in enumerate(words):
            part = "surname" if i == len(words) - 1 else f"given-{gender}"
            at = m.start(2) + w.start()
            found.append((at, at + len(w[0]), f"{part}-{script_of(w[0])}", w[0].lower()))
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[tuple[int, int, str, str]] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def draws(key: bytes, *names: object) -> Iterator[int]:
    """An endless stream of keyed bytes."""
    n = 0
    while True:
        yield from hashlib.blake2b("\x00".join(map(str, (*names, n))).encode(), key=key).digest()
        n += 1


def alike(text: str, draw: Iterator[int]) -> str:
    """Each letter and digit replaced by one of its class; the rest stays."""
    out = []
    hexed = len(text) >= 16 and not text.isdigit() and re.fullmatch("[0-9a-f]+", text) is not None
    for c in text:
        if hexed:
            out.append("0123456789abcdef"[next(draw) % 16])
        elif c.isdigit():
            out.append(str(next(draw) % 10))
        elif c.isalpha():
            new = "abcdefghijklmnopqrstuvwxyz"[next(draw) % 26]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the entity that stands for this one."""
    draw = draws(key, kind, canonical, attempt)
    more = attempt // GROW
    if kind == "phone":
        country, number = canonical.split("/")
        return f"{country}/{alike(number + '0' * more, draw)}"
    if kind == "card":
        body = canonical[0] + alike(canonical[1:-1] + "0" * more, draw)
        last = next(d for d in range(10) if luhn(f"{body}{d}"))
        return f"{body}{last if luhn(canonical) else (last + 1 + next(draw) % 9) % 10}"
    if kind == "ip":
        parts = canonical.split(".")
        lies = network(parts)
        kept = 0 if more or not lies else 2 if lies in ("192.168", "169.254") else 1
        while True:
            new = parts[:kept] + [str(1 + next(draw) % 223) if i == 0 else str(next(draw) % 256) for i in range(kept, 4)]
            if more or network(new) == lies:
                return ".".join(new)
    if kind == "iban":
        country, account = canonical[:2], alike(canonical[4:] + "0" * more, draw)
        right = iban_digits(country, account)
        if canonical[2:4] == iban_digits(country, canonical[4:]):
            return country + right + account
        return f"{country}{(int(right) + 1 + next(draw) % 96) % 97:02d}{account}"
    if kind == "host":
        name, _, ending = canonical.rpartition(".")
        return f"{alike(name + 'x' * (attempt // 4), draw)}.{ending}"
    if kind == "mail":
        local, _, host = canonical.rpartition("@")
        # at its first attempts as long as the original, then longer: short names run out
        return f"{alike(local + 'x' * (attempt // 4), draw)}@{host}"
    if kind.startswith(("given", "surname")):
        consonants, vowels = LETTERS[kind.rsplit("-", 1)[1]]
        size = 2 + attempt // 4 + next(draw) % 2
        word = "".join(consonants[next(draw) % len(consonants)] + vowels[next(draw) % len(vowels)] for _ in range(size))
        if kind.startswith("given-f"):
            return word[:-1] + {"latin": "a", "cyrillic": "а", "greek": "α"}[kind.rsplit("-", 1)[1]]
        return word + consonants[next(draw) % len(consonants)]
    return alike(canonical + "0" * more, draw)


def written(surface: str, kind: str, new: str) -> str:
    """A surrogate in the layout of the text it stands in for; what it is longer by comes last."""
    if kind == "mail":
        return new.rpartition("@")[0]
    if kind == "phone":
        country, number = new.split("/")
        fill = iter(number)
        return country + "".join(next(fill) if c.isdigit() else c for c in surface[len(country):]) + "".join(fill)
    if kind in ("card", "ssn", "iban"):
        fill = iter(new)
        return "".join(next(fill) if c.isalnum() else c for c in surface) + "".join(fill)
    if kind.startswith(("given", "surname")):
        return new.upper() if surface.isupper() and len(surface) > 1 else new.capitalize()
    return new


def surrogates(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, canonical (distinct) to surrogate, distinct within a kind and none of them real."""
    def draw(frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "canonical", "attempt"))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("kind", "canonical", "attempt")]
                    + [pa.array([surrogate(key, *r) for r in rows], pa.string())],
                    names=["kind", "canonical", "attempt", "surrogate"])
        return frame.select("kind", "canonical", "attempt").mapInArrow(
            released(run), "kind string, canonical string, attempt int, surrogate string")

    real = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
    waiting = entities.select("kind", "canonical", F.lit(0).alias("attempt"))
    settled = None
    while True:
        drawn = draw(waiting).withColumn("open", F.lit(1))
        pool = drawn if settled is None else drawn.unionByName(settled.withColumn("open", F.lit(0)))
        # settled before waiting, then the smallest canonical form: one row per surrogate, summed in the tasks
        first = pool.groupBy("kind", "surrogate").agg(F.min(F.struct("open", "canonical")).alias("holder"))
        judged = pool.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left") \
            .withColumn("held", F.col("real").isNull() & (F.col("holder.canonical") == F.col("canonical")))
        judged = materialise(judged.select("kind", "canonical", "attempt", "surrogate", "held"), "surrogates")
        settled = judged.where("held").drop("held")
        waiting = judged.where("NOT held").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return settled.select("kind", "canonical", "surrogate")


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.withColumn(names[0], F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) \
        .withColumn(names[1], F.xxhash64("text"))


def maybe() -> Column:
    return F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))


def with_surrogates(docs: DataFrame, key: bytes = KEY, counted: str | None = None) -> DataFrame:
    """``docs`` with every entity of the text replaced; ``counted`` names a column for their number."""
    names = [unused(docs, "key_id"), unused(docs, "key_text")]
    changes, text = unused(docs, "changes"), "text"
    entities = unused(docs, "entities")

    def detect(batch: list[str]) -> list[list]:
        return [batch, [[dict(zip(ENTITY.elementType.names, e)) for e in find(t)] for t in batch]]

    # Texts that can hold one are picked once and written with what they hold; everything below reads that table.
    held = materialise(map_rows(_keyed(docs.where(maybe()), names), detect, text, f"{text} string, {entities} {ENTITY.simpleString()}"), "held")
    found = held.select(*names, entities).where(F.size(entities) > 0).dropDuplicates(names)
    each = materialise(found.select(*names, F.inline(entities)), "entities")
    held = held.drop(entities).select(*docs.columns, *names)
    mapping = surrogates(each.groupBy("kind", "canonical").agg(F.count("*").alias("n")), key)
    lists = each.join(mapping, ["kind", "canonical"]).groupBy(*names).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias(changes))
    joined = held.join(lists, names, "left").drop(*names)
    out_type = joined.schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for said, edits in zip(batch.column(text).to_pylist(), batch.column(changes).to_pylist()):
                out, at = [], 0
                for e in edits or []:
                    out += [said[at:e["start"]], written(said[e["start"]:e["end"]], e["kind"], e["surrogate"])]
                    at = e["end"]
                new.append(said[at:] if not edits else "".join(out) + said[at:])
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(new, pa.string()))

    moved = joined.mapInArrow(released(replace), out_type)
    number = F.coalesce(F.size(F.filter(changes, lambda e: e["kind"] != "host")), F.lit(0)).cast("long")
    still = docs.where(~maybe())
    if counted:
        moved, still = moved.withColumn(counted, number), still.withColumn(counted, F.lit(0).cast("long"))
    columns = docs.columns + ([counted] if counted else [])
    return moved.select(*columns).unionByName(still.select(*columns))
