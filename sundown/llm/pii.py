"""Personal data replaced by keyed surrogates.

Detected entities get a replacement of the same type and form: letters stay letters of their
script and case, digits stay digits, separators stay; a card keeps its issuer digit and a valid
check digit, an address stays an address, a phone keeps its country code and its reserved middle,
and a name after a title is replaced by one of the title's gender. The replacement is a keyed hash
of the entity, so the same entity reads the same in every document, and other entities read
different: surrogates of all distinct entities are compared with each other and with all
originals, and those that collide are drawn again until none does. Documents without entities
never move.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundown.session import cut_lineage

#: Titles by the gender of the names that follow them; None: either.
TITLES = {
    "Mr": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f",
    "Dr": None, "Prof": None,
}
NAMES = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Marc", "Noel", "Oscar", "Paul", "Simon", "Victor"),
    ("f", "latin"): ("Alma", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irma", "Julia", "Laura", "Maria", "Nora", "Olga", "Petra", "Sonia"),
    ("m", "cyrillic"): ("Алексей", "Борис", "Виктор", "Григорий", "Дмитрий", "Иван", "Максим", "Николай"),
    ("f", "cyrillic"): ("Алина", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("m", "greek"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("f", "greek"): ("Άννα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"),
}
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
# Every quantifier that a longer entity could outgrow is unbounded, and possessive, and a run of an
# address's characters is entered at its beginning only, so that long runs cost their length once.
_WORD = r"(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}'’\-]++)"
_SECRET = r"(?i:password|passwd|secret|token|api[_\-]?key)"
_KEY = r"(?:AKIA|ghp_|sk_live_|xox[bp]-)"
_PATTERN = regex.compile(
    r"(?P<email>(?<![\p{L}\p{N}\p{M}._%+\-])[\p{L}\p{N}\p{M}._%+\-]++@[\p{L}\p{N}\p{M}\-]++(?:\.[\p{L}\p{N}\p{M}\-]++)++)"
    r"|(?P<iban>(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d])\d(?:[ \-]?\d){12,18}(?![\d]))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<phone>(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})|\(\d{3}\))(?:[ .\-]?\d{2,4}){2,4}(?!\d))"
    rf"|(?P<secret>{_SECRET}\s*+[=:]\s*+[\"']?(?P<value>[A-Za-z0-9_\-/+.=~]{{8,}}+))"
    rf"|(?P<key>(?<![\p{{L}}\p{{N}}]){_KEY}[A-Za-z0-9_\-]{{10,}}+)"
    rf"|(?P<name>(?<![\p{{L}}\p{{N}}])(?P<title>{_TITLE})\.?[ ](?P<person>{_WORD}(?:[ ]{_WORD})*+))"
)
#: Whatever the pattern matches holds one of these.
_MARKS = regex.compile(rf"@|\d[ .\-]?\d|\+\d|\(\d|{_SECRET}|{_KEY}|(?:{_TITLE})\.?[ ]\p{{Lu}}")
_PART = regex.compile(r"[^ ]+")


def luhn(digits: str) -> int:
    """The sum of a card number's digits after every second was doubled, modulo ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10


def find_entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """[(start, end, type, detail, original)]; the detail is a name's gender or a card's validity."""
    found = []
    for m in _PATTERN.finditer(text):
        if m["name"]:
            # Every word of a name for itself, so that a family name reads the same without the first one.
            for word in _PART.finditer(m["person"]):
                at = m.start("person") + word.start()
                found.append((at, at + len(word[0]), "name", TITLES[m["title"]] or "", word[0]))
        elif m["secret"]:
            if any(c.isalnum() for c in m["value"]):  # a line of dashes is no secret
                found.append((m.start("value"), m.end("value"), "secret", "", m["value"]))
        else:
            kind = next(k for k in ("email", "iban", "ip", "card", "ssn", "phone", "key") if m[k])
            detail = ""
            if kind == "card":
                detail = "valid" if luhn("".join(c for c in m[0] if c.isdigit())) == 0 else ""
            found.append((m.start(), m.end(), kind, detail, m[0]))
    return found


def _script(word: str) -> str:
    for c in word:
        if c.isalpha():
            name = unicodedata.name(c, "LATIN")
            return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"
    return "latin"


#: First and number of the letters of scripts without case, by the beginning of their letters' names.
ALPHABETS = {
    "CJK": (0x4E00, 20_902), "HANGUL": (0xAC00, 11_172), "HIRAGANA": (0x3042, 82), "KATAKANA": (0x30A2, 82), "ARABIC": (0x0628, 19),
    "HEBREW": (0x05D0, 27), "DEVANAGARI": (0x0915, 37), "BENGALI": (0x0995, 20), "THAI": (0x0E01, 46), "GEORGIAN": (0x10D0, 33),
    "ARMENIAN": (0x0561, 38),
}


def _letter(c: str, r: int) -> str:
    """A letter of the character's script and case, Latin for scripts without an alphabet here; digits for digits; anything else stays."""
    if c.isdigit():
        return str(r % 10)
    if not c.isalpha():
        return c
    script = _script(c)
    first, count = {"latin": (ord("a"), 26), "cyrillic": (ord("а"), 32), "greek": (ord("α"), 17)}[script]
    if script == "latin":
        first, count = ALPHABETS.get(regex.split("[ -]", unicodedata.name(c, "LATIN"))[0], (first, count))
    other = chr(first + r % count)
    return other.upper() if c.isupper() else other


PLAIN_ATTEMPTS = 6  # draws in the entity's own form; later ones are longer by as many characters more


def surrogate(kind: str, detail: str, original: str, key: bytes, attempt: int) -> str:
    """The replacement of an entity; another one for every attempt.

    After ``PLAIN_ATTEMPTS`` the form is given up in favour of a free one: an address leaves its
    network, and keyed letters are appended (an address gets them before its @), more with every
    attempt, so that a form with few members can't be exhausted.
    """
    made = _in_form(kind, detail, original, key, attempt)
    more = attempt - PLAIN_ATTEMPTS
    if more <= 0 or kind == "name":
        return made
    drawn = hmac.new(key, f"more\0{kind}\0{detail}\0{original}\0{attempt}".encode(), hashlib.sha512).digest()
    extra = "".join(_letter("a", drawn[i % len(drawn)] + i) for i in range(more))
    return made.replace("@", f"{extra}@", 1) if kind == "email" else f"{made}-{extra}"


def _in_form(kind: str, detail: str, original: str, key: bytes, attempt: int) -> str:
    seed = hmac.new(key, f"{kind}\0{detail}\0{original}\0{attempt}".encode(), hashlib.sha256).digest()
    stream = hashlib.shake_256(seed).digest(2 * len(original) + 64)
    draws = [int.from_bytes(stream[i : i + 2]) for i in range(0, len(stream), 2)]
    if kind == "name":
        script = _script(original)
        gender = detail or "mf"[draws[0] % 2]
        names = NAMES[gender, script]
        # Names repeat soon; a keyed last part in the same script keeps them apart.
        tail = "".join(_letter({"latin": "a", "cyrillic": "а", "greek": "α"}[script], d) for d in draws[2 : 5 + min(len(draws) - 5, attempt)])
        name = names[draws[1] % len(names)] + "-" + tail.capitalize()
        return name.upper() if original.isupper() and len(original) > 1 else name
    if kind == "ip":
        # A private address stays in its network.
        parts = original.split(".")
        keep = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] else 0
        keep = keep if attempt < PLAIN_ATTEMPTS else 0
        fresh = [str(1 + d % 223) if i == 0 else str(d % 256) for i, d in enumerate(draws[:4])]
        return ".".join([*parts[:keep], *fresh[keep:]])
    if kind == "email":
        local, _, domain = original.partition("@")
        labels = domain.split(".")
        at = len("".join(labels)) + len(labels)
        changed = "".join(_letter(c, d) for c, d in zip(local, draws))
        first = "".join(_letter(c, d) for c, d in zip(labels[0], draws[len(local) : len(local) + at]))
        return changed + "@" + ".".join([first, *labels[1:]])
    if kind == "phone":
        # The country code and the reserved exchange 555 stay.
        head = regex.match(r"\+\d{1,3}(?=[ .\-(])", original)
        start = head.end() if head else 0
        body = "".join(_letter(c, d) for c, d in zip(original[start:], draws))
        at = original.find("555-", start)
        if at >= 0:
            body = body[: at - start] + "555" + body[at - start + 3 :]
        return original[:start] + body
    if kind == "iban":
        return original[:2] + "".join(_letter(c, d) for c, d in zip(original[2:], draws))
    if kind == "key":
        prefix = regex.match(r"AKIA|ghp_|sk_live_|xox[bp]-", original)[0]
        return prefix + "".join(_letter(c, d) for c, d in zip(original[len(prefix) :], draws))
    if kind == "card":
        changed = original[0] + "".join(_letter(c, d) for c, d in zip(original[1:], draws))
        if detail:  # the last digit makes the sum whole again
            for last in "0123456789":
                if luhn("".join(c for c in changed[:-1] + last if c.isdigit())) == 0:
                    return changed[:-1] + last
        return changed
    if regex.fullmatch(r"[0-9a-f]+|[0-9A-F]+", original):  # hexadecimal stays so
        made = "".join(str(d % 10) if c.isdigit() else "abcdef"[d % 6] for c, d in zip(original, draws))
        return made.upper() if original.isupper() else made
    return "".join(_letter(c, d) for c, d in zip(original, draws))


def _assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """entities with the surrogate of their ``attempt``."""
    names = entities.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("type", "detail", "original", "attempt")))
            made = pa.array([surrogate(t, d, o, key, a) for t, d, o, a in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "surrogate"])

    return entities.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in entities.dtypes) + ", surrogate string").select(*names, "surrogate")


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, detail, original, surrogate) of distinct entities; no two originals of a type share one, and none is an original."""
    entities = cut_lineage(entities.select("type", "detail", "original").distinct())
    settled: DataFrame | None = None
    waiting = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = cut_lineage(_assigned(waiting, key))
        originals = entities.select("type", F.col("original").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        seen = drawn.join(originals, ["type", "surrogate"], "left")
        if settled is not None:
            seen = seen.join(
                settled.select("type", "surrogate", F.lit(True).alias("used")).distinct(), ["type", "surrogate"], "left"
            )
        else:
            seen = seen.withColumn("used", F.lit(None).cast("boolean"))
        # Of several with the same surrogate the first original keeps it, under each of its details.
        first = drawn.groupBy("type", "surrogate").agg(F.min("original").alias("first"))
        judged = cut_lineage(
            seen.join(first, ["type", "surrogate"]).withColumn(
                "good", F.col("real").isNull() & F.col("used").isNull() & (F.col("original") == F.col("first"))
            )
        )
        good = judged.filter("good").select("type", "detail", "original", "surrogate")
        settled = good if settled is None else cut_lineage(settled.union(good))
        again = judged.filter("NOT good")
        if again.isEmpty():
            return settled
        waiting = again.select("type", "detail", "original", (F.col("attempt") + 1).alias("attempt"))


_FOUND = "array<struct<start:int,end:int,type:string,detail:string,original:string>>"
_SPAN = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("detail", pa.string()), ("original", pa.string())]
)


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, entities) of every row, null for a row without entities; places count characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text").to_pylist():
                found = find_entities(value) if value and _MARKS.search(value) else []
                rows.append([dict(zip(("start", "end", "type", "detail", "original"), e)) for e in found] or None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(_SPAN))], ["doc_id", "text", "entities"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id bigint, text string, entities {_FOUND}")


def _replaced(found: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, entities of the rows (row, doc_id, text, entities) with their surrogates in place."""
    spans = found.select("row", F.explode("entities").alias("e")).select("row", "e.*")
    mapping = assign_surrogates(spans, key)
    replaced = (
        spans.join(mapping, ["type", "detail", "original"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "surrogate"))).alias("spans"))  # a text's own entities
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                parts, at = [], 0
                for s in spans_:
                    parts += [value[at : s["start"]], s["surrogate"]]
                    at = s["end"]
                out.append("".join([*parts, value[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("spans")], ["doc_id", "text", "entities"])

    return found.join(replaced, "row").select("doc_id", "text", "spans").mapInArrow(
        apply, "doc_id bigint, text string, entities array<struct<start:int,end:int,type:string,surrogate:string>>"
    )


def _searched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every row once searched, under a number of its own, which is given as the table is written."""
    return cut_lineage(detect(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "zstd")


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, entities (type, start, end, surrogate; places in the original) of every row with entities.

    Rows without entities (null and empty texts among them) give no row: their text stays as it
    is. Null and repeated doc_ids stay rows of their own, an empty table gives no rows, other
    columns are ignored. Texts are searched whole.
    """
    return _replaced(_searched(docs, doc_id, text).filter("entities IS NOT NULL"), key)


def pseudonymised_documents(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_entities of every row: those without entities with their own text, null and empty ones among them."""
    searched = _searched(docs, doc_id, text)
    changed = _replaced(searched.filter("entities IS NOT NULL"), key).select("doc_id", "text", F.size("entities").alias("n_entities"))
    return searched.filter("entities IS NULL").select("doc_id", "text", F.lit(0).alias("n_entities")).union(changed)
