"""Personal data and secrets replaced by keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity within the strings of its own format, so
equal entities get equal surrogates wherever they occur, and different ones different ones, without
a look-up table. Names go by their own spelling alone, not by the sentence they stand in: a person has one surrogate everywhere.
A surname's ending that tells a gender stays, and its stem has one surrogate whatever the ending; a listed given name goes to one of its
gender, another one keeps its last letter. What a permutation can't rule out, a surrogate that is itself or is somebody else's real
value, is checked over the whole corpus, as is that no two entities share one: such entities get another surrogate, which collides with none.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, map_arrow, quoted, stored, text_key

#: For tests and demonstrations; a production run passes its own.
DEMO_KEY = b"millrace demonstration key"
#: Exceptions up to so many are handed to every task; more are joined to the documents.
SMALL_EXCEPTIONS = 200_000
#: Tries to find another surrogate of the same length for a name whose first one is taken; later ones are longer by a syllable.
SAME_LENGTH = 4
#: Tries in a row that find nothing for any entity; a format of which no string is free is an error.
VAIN = 40

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĻŁŃŅŇŌŐŒŘŚŞŠŢŤŪŮŰŲŹŻŽΑ-ΩА-ЯЁІЇЄ"
_NAME = rf"[{_UP}][^\W\d_]+(?:['’-][{_UP}][^\W\d_]+)*"
_MALE, _FEMALE, _ANY = "m", "f", "x"
_TITLES = {
    "Mr": _MALE, "Herr": _MALE, "Herrn": _MALE, "Monsieur": _MALE, "Señor": _MALE, "Sr": _MALE, "Господин": _MALE, "Г-н": _MALE, "Κύριος": _MALE,
    "Mrs": _FEMALE, "Ms": _FEMALE, "Miss": _FEMALE, "Frau": _FEMALE, "Madame": _FEMALE, "Mme": _FEMALE, "Mlle": _FEMALE, "Señora": _FEMALE, "Señorita": _FEMALE, "Sra": _FEMALE, "Srta": _FEMALE, "Госпожа": _FEMALE, "Г-жа": _FEMALE, "Κυρία": _FEMALE,
    "Dr": _ANY, "Prof": _ANY, "Mx": _ANY,
}
_GIVEN = {
    ("latin", _MALE): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Andrew Paul Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Hans Jürgen Wolfgang Klaus Stefan Pierre Jacques François Louis Carlos Miguel José Javier Pedro Diego".split(),
    ("latin", _FEMALE): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Kimberly Emily Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Kathleen Amy Angela Shirley Ursula Sabine Monika Petra Claudia Françoise Juliette Camille Brigitte Carmen Lucía María Dolores Isabel Pilar".split(),
    ("cyrillic", _MALE): "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Павел Владимир Олег Юрий Виктор Борис".split(),
    ("cyrillic", _FEMALE): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия Галина Людмила Вера Надежда".split(),
    ("greek", _MALE): "Γιώργος Γιάννης Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης Χρήστος".split(),
    ("greek", _FEMALE): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
}
_LEXICON = {name: (group, names) for group, names in _GIVEN.items() for name in names}

EMAIL = re.compile(r"[\w.+%-]*[\w+%-]@[\w-]+(?:\.[\w-]+)+")
SECRET = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?token)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-/+=.]{8,})")
NUMERIC = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, _TITLES), key=len, reverse=True))})\.?[  ]+({_NAME}(?:[  ]{_NAME}){{0,2}})")
INTRODUCED = re.compile(rf"(?:[Mm]y name is|[Jj]e m['’]appelle|[Mm]e llamo|[Ii]ch hei(?:ß|ss)e|[Мм]еня зовут)[  ]+({_NAME}(?:[  ]{_NAME}){{0,2}})")
LISTED = re.compile(rf"(?<!\w)((?:{'|'.join(sorted(map(re.escape, _LEXICON), key=len, reverse=True))})(?:[  ]{_NAME}){{1,2}})(?!\w)")

#: What must be somewhere in a text that names a person; tells the other texts quickly.
_NAMING = ahocorasick.Automaton()
for _word in (*_TITLES, *_LEXICON, "y name is", "e m'appelle", "e m’appelle", "e llamo", "ch heiße", "ch heisse", "еня зовут"):
    _NAMING.add_word(_word, 1)
_NAMING.make_automaton()

# Letters without a capital of their own (ß, final ς) and signs that change the letter before them (ъ, ь) stay where they are.
_LATIN = ("bcdfghjklmnpqrstvwxyz", "aeiou", "àâäáãåæèêëéìîïíòôöóõøœùûüú", "çñý")
_OTHER = ("αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "іїєґ")
#: Endings of surnames, those of men and women; the rest of the name is the family's.
_ENDINGS = sorted("ов ова ев ева ёв ёва ин ина ын ына ский ская цкий цкая ой ая ίδης ίδου άκης άκη ος ου ης η ας α".split(), key=len, reverse=True)
_PRONOUNCED = (*_LATIN, *_OTHER)
_FREE = ("abcdefghijklmnopqrstuvwxyz", *_LATIN[2:], *_OTHER)
#: Letters of scripts without case, as (first, last) code points.
_RANGES = ((0x4E00, 0x9FFF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3), (0x0621, 0x064A), (0x05D0, 0x05EA), (0x0905, 0x0939))
_HEX = "0123456789abcdef"


def script(text: str) -> str:
    c = text[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def permute(number: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0..size - 1: a Feistel network, walked until it is inside."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    seed = hashlib.blake2b(label.encode(), key=key[:64]).digest()
    while True:
        left, right = number >> half, number & mask
        for r in range(8):
            f = hashlib.shake_256(seed + bytes([r]) + right.to_bytes(width, "big")).digest(width)
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        number = left << half | right
        if number < size:
            return number


def _permute_text(text: str, alphabets: tuple[str, ...], key: bytes, label: str) -> str:
    """text with every letter and digit exchanged for one of the same alphabet and case; other characters stay."""
    where: list[tuple[int, str | int, bool]] = []
    number, size, shape = 0, 1, []
    for i, c in enumerate(text):
        low = c.lower() if len(c.lower()) == 1 else c
        if c in "0123456789" and alphabets[0] is not _HEX:
            options, at = "0123456789", int(c)
        elif found := next((a for a in alphabets if low in a), None):
            options, at = found, found.index(low)
        elif span := next((r for r in _RANGES if r[0] <= ord(c) <= r[1]), None):
            options, at = span, ord(c) - span[0]
        else:
            shape.append(c)
            continue
        n = len(options) if isinstance(options, str) else options[1] - options[0] + 1
        where.append((i, options, c != low))
        shape.append(str(options)[:3])
        number, size = number * n + at, size * n
    number = permute(number, size, key, label + "|" + "".join(shape))
    out = list(text)
    for i, options, upper in reversed(where):
        n = len(options) if isinstance(options, str) else options[1] - options[0] + 1
        number, at = divmod(number, n)
        c = options[at] if isinstance(options, str) else chr(options[0] + at)
        out[i] = c.upper() if upper and len(c.upper()) == 1 else c
    return "".join(out)


def ending(name: str) -> str:
    """The ending of a surname that tells a gender; at least two letters are left before it."""
    return next((e for e in _ENDINGS if name.endswith(e) and len(name) - len(e) >= 2), "")


def _name(value: str, kept: int, key: bytes, label: str) -> str:
    """value with another stem, its last letters kept; the result has the same ending as value, which makes this a permutation too."""
    stem, rest, wanted = value[: len(value) - kept], value[len(value) - kept :], ending(value)
    while True:
        stem = _permute_text(stem, _PRONOUNCED, key, label)
        if ending(stem + rest) == wanted:
            return stem + rest


def _luhn(digits: str) -> int:
    """The check digit that digits want."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, raw: str) -> str:
    """What makes two spellings one entity: digits of numbers, case-folded letters of addresses."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in raw if c in "0123456789")
    if kind == "iban":
        return raw.replace(" ", "")
    return raw.lower() if kind == "email" and len(raw.lower()) == len(raw) else raw


def surrogate(kind: str, value: str, key: bytes, again: int = 0) -> str:
    """Of a canonical value; again counts the tries. Of the same length, but for IP addresses, listed given names and names tried often."""
    label = f"{kind}|{again}"
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        kept = 2 if len(labels) > 2 or labels[-2] == "example" else 1
        own = ".".join(labels[:-kept])
        return _permute_text(local, _FREE, key, label + "|local") + "@" + ".".join([*([_permute_text(own, _FREE, key, "domain")] if own else []), *labels[-kept:]])
    if kind == "secret":
        hexadecimal = all(c in _HEX for c in value)
        return _permute_text(value, (_HEX,) if hexadecimal else _FREE, key, label)
    if kind == "ip":
        return _ip(value, key, label)
    if kind == "card":
        body = value[0] + _permute_text(value[1:-1], ("",), key, label + "|" + value[0])
        return body + str((_luhn(body) + int(value[-1]) - _luhn(value[:-1])) % 10)
    if kind == "phone":
        national = value[-10:]
        return value[: -len(national)] + _permute_text(national, ("",), key, label)
    if kind == "iban":
        body = _permute_text(value[4:], _FREE, key, label + "|" + value[:2])
        valid = _mod97(value) == 1
        return value[:2] + (f"{98 - _mod97(value[:2] + '00' + body):02d}" if valid else value[2:4]) + body
    if kind.startswith("given"):
        group, names = _LEXICON.get(value, (None, None))
        if names:
            order = sorted(names, key=lambda n: hashlib.blake2b(f"{group}|{n}".encode(), key=key[:64]).digest())
            return order[(order.index(value) + 1 + again) % len(order)]
        return _permute_text(_longer(value[:-1], again), _PRONOUNCED, key, label) + value[-1]  # endings tell genders
    if kind == "surname":
        kept = len(ending(value))
        grown = _longer(value[: len(value) - kept], again) + value[len(value) - kept :]
        return _name(grown, kept, key, label)
    return _permute_text(value, ("",), key, label)


def _longer(name: str, again: int) -> str:
    """name, from some tries on with syllables more, in letters of its script; the permutation makes others of them."""
    return name + max(0, again - SAME_LENGTH) * {"cyrillic": "на", "greek": "να", "latin": "na"}[script(name or "a")]


def _ip(value: str, key: bytes, label: str) -> str:
    a, b, c, d = map(int, value.split("."))
    number = a << 24 | b << 16 | c << 8 | d
    kept = 8 if a in (0, 10, 127) else 12 if a == 172 and b >> 4 == 1 else 16 if (a, b) == (192, 168) else 4 if a >= 224 else 0
    free = 32 - kept
    while True:
        number = number >> free << free | permute(number & (1 << free) - 1, 1 << free, key, f"{label}|{number >> free}")
        octets = [number >> s & 255 for s in (24, 16, 8, 0)]
        if kept or not (octets[0] in (0, 10, 127) or octets[0] >= 224 or octets[0] == 172 and octets[1] >> 4 == 1 or octets[:2] == [192, 168]):
            return ".".join(map(str, octets))


def render(kind: str, raw: str, value: str) -> str:
    """value in raw's spelling: its separators and capitals."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(value)
        return "".join(next(rest) if c.isalnum() else c for c in raw)
    if kind == "email" and len(raw) == len(value):
        return "".join(v.upper() if c.isupper() and len(v.upper()) == 1 else v for c, v in zip(raw, value))
    return value


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's entities, in order, none overlapping another."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in SECRET.finditer(text)]
    if _DIGIT.search(text):
        for m in NUMERIC.finditer(text):
            if m.lastgroup != "phone" or 7 <= len(canonical("phone", m.group())) <= 15:
                found.append((m.start(), m.end(), m.lastgroup))
    people: dict[str, str] = {}
    for pattern, group in ((TITLED, 2), (INTRODUCED, 1), (LISTED, 1)) if next(_NAMING.iter(text), None) else ():
        for m in pattern.finditer(text):
            parts = m.group(group).split()
            if len(parts) > 1 or group == 1:
                people.setdefault(parts[0], "given")
                parts = parts[1:]
            for p in parts:
                people.setdefault(p, "surname")
    if people:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, people), key=len, reverse=True))})(?!\w)")
        found += [(m.start(), m.end(), people[m.group()]) for m in again.finditer(text)]
    order = {"email": 0, "secret": 1}
    taken: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda s: (order.get(s[2], 2), s[0])):
        # Those taken don't overlap, so only the neighbours on both sides can be in the way.
        at = bisect.bisect_left(taken, span)
        if (not at or taken[at - 1][1] <= span[0]) and (at == len(taken) or taken[at][0] >= span[1]):
            taken.insert(at, span)
    return taken


_DIGIT = re.compile(r"\d")


def replace(text: str, key: bytes, exceptions: dict[tuple[str, str], str] | None = None) -> tuple[str, int]:
    """text with surrogates, and how many."""
    spans = find(text)
    out, at = [], 0
    for a, b, kind in spans:
        raw = text[a:b]
        value = canonical(kind, raw)
        new = (exceptions or {}).get((kind, value)) or surrogate(kind, value, key)
        out += [text[at:a], render(kind, raw, new)]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def entities(docs: DataFrame) -> DataFrame:
    """key (of the text), kind, value of the entities in docs; distinct within a text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, kind, value) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind, value in {(kind, canonical(kind, t[a:b])) for a, b, kind in find(t)}]
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))], names=["key", "kind", "value"])

    texts = docs.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text"))
    return map_arrow(texts.select(text_key().alias("key"), "text"), run, "key binary, kind string, value string")


def _surrogates(table: DataFrame, key: bytes, again: int) -> DataFrame:
    """kind, value, new, listed (given names of the list, which go to one another)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        new, listed = [surrogate(k, v, key, again) for k, v in rows], [k == "given" and v in _LEXICON for k, v in rows]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(new, pa.string()), pa.array(listed, pa.bool_())], names=["kind", "value", "new", "listed"])

    return map_arrow(table.select("kind", "value"), run, "kind string, value string, new string, listed boolean")


def collisions(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """kind, value, new of the entities whose first surrogate is a real value of the corpus (their own, say) or another entity's surrogate too, with another one.

    The new ones differ from all real values and all surrogates of their kind. Given names from the list go to one another
    and are left out, as any of them is somebody's; no other given name gets one of them. A format of which no string is free raises ValueError.
    """
    spark = docs.sparkSession
    real = stored(entities(docs).select("kind", "value").distinct())
    first = stored(_surrogates(real, key, 0))
    # Tables of Arrow are made without Python workers, which would stay beside those of the operators.
    listed = spark.createDataFrame(pa.table({"kind": ["given"] * len(_LEXICON), "value": list(_LEXICON)}), "kind string, value string")
    known = real.unionByName(listed).withColumnRenamed("value", "new")
    twice = first.groupBy("kind", "new").agg(F.count("*").alias("n")).where("n > 1")
    bad = first.join(known, ["kind", "new"], "left_semi").unionByName(first.join(twice, ["kind", "new"], "left_semi"))
    open_ = stored(bad.where("NOT listed").select("kind", "value").distinct())
    taken = known.unionByName(first.select("kind", "new"))
    out, again, vain = None, 0, 0
    while not open_.isEmpty():
        again += 1
        tried = _surrogates(open_, key, again).join(taken, ["kind", "new"], "left_anti")
        found = stored(tried.groupBy("kind", "new").agg(F.min("value").alias("value")).select("kind", "value", "new"))
        vain = vain + 1 if found.isEmpty() else 0
        if vain == VAIN:
            kind, value = open_.first()
            raise ValueError(f"no free {kind} of the format of {surrogate(kind, value, key)}")
        out = found if out is None else out.unionByName(found)
        taken = taken.unionByName(found.select("kind", "new"))
        open_ = stored(open_.join(found, ["kind", "value"], "left_anti"))
    return out if out is not None else spark.createDataFrame(pa.table({c: pa.array([], pa.string()) for c in ("kind", "value", "new")}), "kind string, value string, new string")


def _replaced(docs: DataFrame, key: bytes) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the new text and the number of surrogates in it."""
    odd = stored(collisions(docs, key))
    many = odd.count()
    known = {} if many > SMALL_EXCEPTIONS else {(r[0], r[1]): r[2] for r in odd.collect()}
    handle = docs.sparkSession.sparkContext.broadcast(known)
    text, count, own_odd, row_key = free(docs, "new_text", "replaced", "odd", "key")
    names = quoted(*docs.columns)
    source = docs.select(*names, F.lit(None).cast("array<struct<kind:string,value:string,new:string>>").alias(own_odd))
    if many > SMALL_EXCEPTIONS:
        own = entities(docs).join(odd, ["kind", "value"]).groupBy("key").agg(F.collect_set(F.struct("kind", "value", "new")).alias(own_odd)).withColumnRenamed("key", row_key)
        source = docs.withColumn(row_key, text_key(F.col("text").cast("string"))).join(own, row_key, "left").select(*names, own_odd)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        odd_rows = batch.column(batch.num_columns - 1)
        own = odd_rows.to_pylist() if odd_rows.null_count < batch.num_rows else [None] * batch.num_rows
        new = [replace(t, key, {(o["kind"], o["value"]): o["new"] for o in x} if x else handle.value) if t is not None else (None, 0) for t, x in zip(batch.column(at).to_pylist(), own)]
        yield pa.record_batch([*batch.columns[:-1], pa.array([n[0] for n in new], pa.string()), pa.array([n[1] for n in new], pa.int32())], names=[*batch.schema.names[:-1], text, count])

    out = map_arrow(source, run, docs.select(*names, F.lit(None).cast("string").alias(text), F.lit(None).cast("int").alias(count)).schema)
    return out, text, count


def replaced(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """doc_id, text with surrogates, n_replaced for each row of docs.

    Null texts stay null with n_replaced 0; texts without entities, empty ones too, stay as they are; very long ones are searched whole. Repeated rows get equal results.
    Entities are e-mail and IP addresses, telephone, card, social security and bank account numbers, secrets
    after a word that names them, and persons' names after a title or an introduction or with a known given name, with every
    later mention in the same text. Of entities that overlap, e-mail addresses come first, then secrets, then what begins first. Numbers keep their separators and valid check digits, addresses their networks'
    kind and the ends of their domains, names their script, case and gender. Other columns, whatever their names, are ignored. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, text, count = _replaced(docs, key)
    return out.select("doc_id", F.col(text).alias("text"), F.col(count).alias("n_replaced"))


def anonymised(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """docs, all rows and columns, with surrogates in text and n_chars (if there is such a column) set anew where that changed; see replaced().

    Rows with null, empty or clean texts are as they were. Other columns may have any names. An empty table gives an empty one.
    """
    out, text, count = _replaced(docs, key)
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(count) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else quoted(c)[0] for c in docs.columns])
