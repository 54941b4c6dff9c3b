"""Personal information in free text, by bootstrapped contextual extraction.

One pass over the texts lists candidate spans: strings of the shape of an address, number or name, with the words around
them. Candidates that their own form or a cue gives away, and names made of known parts, are seeds. Seeds make the lexical
patterns around them credible, credible patterns and known partners make new instances credible, and so on: Spark scores the
graph of patterns and instances in rounds, until a round finds nothing new. Candidates that are credible in the end are the
findings. Of each type there are strict forms, which are seeds, and loose ones, which only patterns can make credible.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bits import bit_table, bits_for, may_be_in
from siltstone.plans.lineage import cut

TYPES = ("email", "phone", "id_number", "address", "name")

#: A new name part needs one of these shares of its occurrences beside known parts, of so many different ones: machines and
#: branches are called after people, so a small share will do with more partners. A pattern needs this share of accepted
#: instances, and so many different ones.
PART_SHARE, PART_PARTNERS = 0.3, 2
LOW_PART_SHARE, LOW_PART_PARTNERS = 0.08, 3
PATTERN_SHARE, PATTERN_INSTANCES = 0.6, 4

#: Two credible patterns make an instance credible, or a single one with so many accepted instances and this share of them.
STRONG_SHARE, STRONG_INSTANCES = 0.75, 8

_L = r"[^\W\d_]"

# Notations of email addresses.
_LOCAL = r"[^\W_](?:[\w.+\-]*[^\W_])?"
_HOST = r"[^\W_](?:[\w\-]*[^\W_])?"
_EMAIL = re.compile(rf"(?<![\w.+\-@]){_LOCAL}\s?(?:@|%40|＠|&#64;|\\u0040)\s?{_HOST}(?:\.{_HOST})*\.{_L}{{2,}}(?![\w@])(?!:[\w/])", re.I)
_AT = r"(?:\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+|_at_)"
_DOT = r"(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+|_dot_|\.)"
_SPELT = re.compile(rf"(?<![\w.+\-@]){_LOCAL}{_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}{_L}{{2,}}(?![\w@])", re.I)
#: A loose form of an address, as in "jane at example . com", which is told from prose by what stands around it.
_LOOSE_EMAIL = re.compile(rf"(?<![\w.+\-@]){_LOCAL}\s+(?:at|AT|@)\s+{_HOST}(?:\s?\.\s?{_HOST})*\s?\.\s?{_L}{{2,}}(?![\w@])")
_REMOTE_USERS = {"git", "hg", "svn", "ssh", "root", "npm"}

# What a number issued by an authority is called.
_CUE = re.compile(
    r"(?:\b(?:ssn|social[ -]security(?:[ -](?:number|no|nr|num)\.?)?|national[ -](?:id|identity|insurance)(?:[ -](?:card|number|no|nr)\.?)*|identity (?:card|number)|id card|"
    r"passport|passeport|pasaporte|reisepass|pasaport|personalausweis|steuer-?\s?id(?:nr)?|steueridentifikationsnummer|steuernummer|tax(?:payer)?[ -]?(?:id|number|no|identification number)|tin|itin|"
    r"dni|nif|nie|nino|ni (?:number|no)|(?:t\.?c\.? ?)?kimlik|tckn|vergi|insee|num[ée]ro fiscal|sécurité sociale|sozialversicherungsnummer|driver'?s? licen[cs]e|driving licen[cs]e|aadhaar|pesel|cpf|codice fiscale))"
    r"[\s:=#.\-]*(?:(?:is|was|n[ro°º]|num(?:ber|mer|arası|ero)?|numéro|no|id)\b[\s:=#.]*){0,2}[\"'`(]?$",
    re.I,
)
_NUMBER = re.compile(r"(?<![\w.])(?:[+(]\s?)?\d(?:[\d(). \-/]*\d)?(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?:-?[A-Z]\b)?")
_LETTERED = re.compile(r"(?<![\w\-])(?:[A-Z]{1,3}[ \-]?\d{6,9}[A-Z]?|[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D])(?![\w\-])")
_ID_SHAPE = re.compile(r"\d{3}-\d\d-\d{4}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D]")
_NO_PERSON = re.compile(r"(?:\b(?:part|ticket|order|run|commit|build|job|epoch|trace|version|issue|port|row|invoice|serial|item|sku|lot|batch)(?:\s(?:no|id|number|nr)\.?)?|#)[\s:=#]*$", re.I)

# Notations of phone numbers.
_PHONE = re.compile(
    r"\+\d{1,3}[ \-.]?(?:\(0\))?[\d \-.()]{6,16}\d|00\d{1,3}[ \-.]?\d[\d \-.]{6,14}\d|\(\d{3,5}\)\s?\d{3,4}[ \-.]?\d{3,4}|1?[ \-.]?\d{3}([ \-.])\d{3}\1\d{4}|"
    r"0\d{2,4}[ \-./]\d{3,8}(?:[ \-]\d{2,5})?|0\d{3}[ \-]\d{3}[ \-]\d{3,4}|0\d(?:[ .]\d\d){4}"
)
_PHONE_CUE = re.compile(r"(?:\b(?:tel(?:efon|efono|éfono|ephone)?|phone|call(?:ed)?|mobile|mob|cell|fax|handy|whatsapp|pager|gsm|ara|sms)\b[\s.:=#]*(?:(?:is|at|on|no|number)\b[\s.:]*)?)$", re.I)

# Words that make a street.
_NAME_WORD = rf"(?:[A-ZÄÖÜÇĞİŞÉÈÀÑ]{_L}*(?:['’\-]{_L}+)*|St\.|Mt\.|Dr\.)"
_STREETS = r"Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Place|Pl|Square|Sq|Terrace|Close|Crescent|Row|Walk|Parkway|STREET|ST|ROAD|RD|AVENUE|AVE|LANE|LN|DRIVE|DR|COURT|CT|WAY|BOULEVARD|BLVD|PLACE|SQUARE|TERRACE|CLOSE|CRESCENT"
_RUES = r"rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|RUE|AVENUE|BOULEVARD|Rue|Avenue|Boulevard"
_ADDRESSES = [
    re.compile(rf"(?<![\w.\-/])\d{{1,5}}[A-Za-z]?,?\s+(?:[NSEW]{{1,2}}\.?\s+)?(?:{_NAME_WORD}\s+){{1,3}}(?:{_STREETS})\b\.?"),
    re.compile(rf"(?<![\w.\-/])\d{{1,5}}[a-z]?,?\s+(?:{_L}+\s+){{1,2}}(?:street|road|avenue|lane|court|boulevard)\b,?\s+{_L}+,?\s+\d{{4,5}}"),
    re.compile(rf"(?<![\w+/=]){_L}(?:{_L}|-)*?(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|STRASSE|STRAßE|STR\.)\s*(?:Nr\.?\s*)?\d{{1,4}}\s?[A-Za-z]?(?![\w])"),
    re.compile(rf"(?<!\w)(?:[A-ZÄÖÜ]{_L}+(?:er|es)?\s)(?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee)\s*(?:Nr\.?\s*)?\d{{1,4}}\s?[a-z]?(?!\w)"),
    re.compile(rf"(?<![\w.\-/])\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s+(?:{_RUES})\s+(?:(?:du|de\sla|des|de|DU|DE\sLA|DES|DE)\s+|d['’]|l['’])?{_NAME_WORD}"),
    re.compile(rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrer|CALLE|AVENIDA|calle|Via|Viale|Rua)\s+(?:(?:de|del|de\sla)\s+)?{_NAME_WORD}(?:\s{_NAME_WORD})?,?\s+(?:n[º°o]?\.?\s*)?\d{{1,4}}", re.I),
    re.compile(rf"(?<!\w){_L}+(?:\s{_L}+)?\s+(?:Sokak|Sokağı|Sok\.|Sk\.|Caddesi|Cad\.|Cd\.|Bulvarı|SOKAK|CADDESİ|CADDESI|sokak|caddesi)\s*,?\s*(?:No\s?[:.]?\s*|NO\s?[:.]?\s*|no\s?[:.]?\s*)?\d{{1,4}}"),
]
#: A loose form: a number and capitalised words, of a street of whatever kind.
_LOOSE_ADDRESS = re.compile(rf"(?<![\w.\-/#:+=]){chr(92)}d{{1,4}}[a-z]?,?[ ](?:{_NAME_WORD}[ ])?{_NAME_WORD}(?![\w(=:/])")
_DIGIT = re.compile(r"\d")

# What a match of the patterns above holds; expressions as written, strings in lower case.
_STREET_SIGN, _RUE_SIGN = re.compile(rf"\s(?:{_STREETS})\b"), re.compile(rf"\s(?:{_RUES})\s")
_OTHER_SIGNS = (
    (("street", "road", "avenue", "lane", "court", "boulevard"), _ADDRESSES[1:2]),
    (("straße", "strasse", "str.", "weg", "gasse", "platz", "allee"), _ADDRESSES[2:4]),
    (("calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "carrer", "via", "rua"), _ADDRESSES[5:6]),
    (("sok", "sk.", "cad", "cd.", "bulvar"), _ADDRESSES[6:]),
)

_WORDS = re.compile(rf"{_L}+")
_CAPITALS = re.compile(rf"(?<![\w.@\-])(?:[A-ZÀ-ÝÇĞİŞ]{_L}{{2,}}(?:,? |\s[A-Z]\.?\s)[A-ZÀ-ÝÇĞİŞ]{_L}{{2,}}|[A-ZÀ-Ý]\.\s?[A-ZÀ-ÝÇĞİŞ]{_L}{{2,}})(?![\w@])")
_TOKENS = re.compile(r"\w+|[^\w\s]")

SPAN_SCHEMA = T.StructType(
    [T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("text_key", T.LongType()), T.StructField("pii_type", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]
    + [T.StructField("sure", T.BooleanType()), T.StructField("instance", T.StringType()), T.StructField("given", T.StringType()), T.StructField("family", T.StringType()), T.StructField("caps", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.StringType()))]
    + [T.StructField("word", T.StringType()), T.StructField("count", T.LongType())]
)


def _around(text: str, first: int, end: int) -> list[str]:
    """Lexical patterns of a span: two words before it, two after it, and one on either side; digits read as 0."""
    plain = lambda ts: [re.sub(r"\d+", "0", t.lower()) for t in ts]
    line = text[max(0, first - 60) : first]
    left = plain(_TOKENS.findall(line.rsplit("\n", 1)[-1]))[-2:]
    right = plain(_TOKENS.findall(text[end : end + 60].split("\n", 1)[0]))[:2]
    left, right = ["^", "^", *left][-2:], [*right, "$", "$"][:2]
    return ["l\t" + " ".join(left), "r\t" + " ".join(right), f"m\t{left[1]}\t{right[0]}"]


#: Spaces and dashes that look like plain ones, each read as one, so that places stay the same.
_PLAIN = {**dict.fromkeys(map(ord, "\u00a0\u2002\u2003\u2007\u2009\u200a\u202f"), " "), **dict.fromkeys(map(ord, "\u2010\u2011\u2012\u2013\u2014\u2212"), "-")}


def _overlaps(spans: list[tuple], first: int, end: int) -> bool:
    return any(first < s[2] and s[1] < end for s in spans)


def _streets(text: str, low: str) -> list[re.Pattern]:
    """The street patterns that may match a text, in their order; low: the text in lower case."""
    if not text.isascii():  # letters that are i or s where case is ignored
        low = low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")
    fit = {_ADDRESSES[0]: bool(_STREET_SIGN.search(text)), _ADDRESSES[4]: bool(_RUE_SIGN.search(text))}
    for signs, patterns in _OTHER_SIGNS:
        fit |= dict.fromkeys(patterns, any(sign in low for sign in signs))
    return [p for p in _ADDRESSES if fit[p]]


def spans_of(text: str, parts: dict[str, str], words: list[str] | None = None) -> list[tuple]:
    """Candidates of a text: (type, first, end, sure, instance, given, family). parts: known name parts in lower case.
    words: the text's words in lower case, if they are there already."""
    out: list[tuple] = []
    text = text if text.isascii() else text.translate(_PLAIN)
    low = text.lower()
    if "@" in text or "%40" in text or "＠" in text or "&#64;" in text or "\\u0040" in text:
        for m in _EMAIL.finditer(text):
            user = re.split(r"@|%40|＠|&#64;|\\u0040", m.group())[0].strip()
            if user.lower() not in _REMOTE_USERS and text[max(0, m.start() - 3) : m.start()] != "://":
                out.append(("email", m.start(), m.end(), True, m.group().lower(), None, None))
    if "dot" in low or "at]" in low or "at)" in low or "_at_" in low or "at}" in low or "at>" in low:
        for m in _SPELT.finditer(text):
            spelt = re.search(r"[\[({<_]\s?at\s?[\])}>_]|dot", m.group(), re.I)
            if not _overlaps(out, m.start(), m.end()):
                out.append(("email", m.start(), m.end(), bool(spelt), m.group().lower(), None, None))
    if " at " in low or " @ " in low:
        for m in _LOOSE_EMAIL.finditer(text):
            if not _overlaps(out, m.start(), m.end()):
                out.append(("email", m.start(), m.end(), False, m.group().lower(), None, None))
    if _DIGIT.search(text):
        _numbered(text, low, out)
    _names(text, _WORDS.findall(low) if words is None else words, parts, out)
    return out


def _numbered(text: str, low: str, out: list[tuple]) -> None:
    """Adds the candidates that hold a digit."""
    for pattern in _streets(text, low):
        for m in pattern.finditer(text):
            if not _overlaps(out, m.start(), m.end()) and text[max(0, m.start() - 1) : m.start()] not in ("`", "/"):
                out.append(("address", m.start(), m.end(), True, m.group().lower(), None, None))
    for m in _LETTERED.finditer(text):
        cued = bool(_CUE.search(text[max(0, m.start() - 48) : m.start()]))
        shaped = bool(_ID_SHAPE.fullmatch(m.group()))
        if not _overlaps(out, m.start(), m.end()):
            out.append(("id_number", m.start(), m.end(), cued or shaped, m.group(), None, None))
    for m in _NUMBER.finditer(text):
        span = m.group()
        digits = sum(map(str.isdigit, span))
        if digits < 7:
            continue
        first, end = m.start(), m.end()
        if (first and text[first - 1] in "`_-/.:@=" and text[first - 1] not in ":=") or text[end : end + 1] in ("_", "@") or _overlaps(out, first, end):
            continue
        before = text[max(0, first - 48) : first]
        plain = span
        core = re.sub(r"\s?(?:ext\.?|x)\s?\d{1,5}$", "", plain)
        if _CUE.search(before):
            out.append(("id_number", first, end, True, span, None, None))
        elif _NO_PERSON.search(before):
            continue
        elif re.fullmatch(r"\d{3}-\d\d-\d{4}|\d{8}-[A-Z]|[XYZ]-\d{7}-[A-Z]", plain):
            out.append(("id_number", first, end, True, span, None, None))
        elif digits <= 15 and _PHONE.fullmatch(core) and not re.match(r"(?:19|20)\d\d[-./]\d\d", core):
            out.append(("phone", first, end, True, span, None, None))
        elif digits <= 15 and _PHONE_CUE.search(before) and not re.match(r"(?:19|20)\d\d[-./]\d\d", core):
            out.append(("phone", first, end, True, span, None, None))
        elif digits <= 15 and not re.match(r"(?:19|20)\d\d[-./]\d\d", core):
            shape = re.sub(r"\d", "0", plain)
            out.append(("id_number", first, end, False, span, None, None))
            if shape[0] in "+(0":
                out.append(("phone", first, end, False, span, None, None))
    for m in _LOOSE_ADDRESS.finditer(text):
        led = text[max(0, m.start() - 40) : m.start()].rsplit("\n", 1)[-1]
        if _WORDS.search(led) and not _overlaps(out, m.start(), m.end()):
            out.append(("address", m.start(), m.end(), False, m.group().lower(), None, None))


def _names(text: str, words: list[str], parts: dict[str, str], out: list[tuple]) -> None:
    known = not parts.keys().isdisjoint(words)
    seen: set[tuple[int, int]] = set()

    def add(a: int, b: int, x: str, y: str, sure: bool, reverse: bool = False) -> None:
        if (a, b) not in seen and not _overlaps([s for s in out if s[0] in ("email", "address") and s[3]], a, b):
            seen.add((a, b))
            given, family = (y, x) if reverse else (x, y)
            out.append(("name", a, b, sure, f"{x} {y}", given, family))

    if known:
        ms = list(_WORDS.finditer(text))
        lows = [m.group().lower() for m in ms]
        for i, w in enumerate(lows):
            if w not in parts:
                continue
            for j, k in ((i - 1, i), (i, i + 1), (i - 2, i), (i, i + 2)):
                if j < 0 or k >= len(ms):
                    continue
                a, b = ms[j], ms[k]
                gap = text[a.end() : b.start()]
                x, y = lows[j], lows[k]
                if k - j == 2:
                    if not re.fullmatch(r"\s[A-Za-z]\.?\s", gap):
                        continue
                elif len(x) == 1:
                    if not re.fullmatch(r"\.\s?", gap) and not (gap == " " and a.group().isupper() and x not in "ai"):
                        continue
                elif len(y) == 1 or not re.fullmatch(r"\s|,[ \t]?", gap):
                    continue
                if text[a.start() - 1 : a.start()] in ("_", "`", "/", "@", ".", "-", "+") or text[b.end() : b.end() + 1] in ("_", "/", "@", "`"):
                    continue
                comma = "," in gap
                kinds = parts.get(x), parts.get(y)
                if comma and not (kinds[0] and kinds[1]) and not (b.group()[:1].isupper() and a.group()[:1].isupper()):
                    continue
                sure = bool(kinds[0] and kinds[1]) and (kinds[0] != kinds[1] or "both" in kinds)
                # Parts of one name are written alike; an unknown part stands where its kind does: given names come first,
                # family names before a comma.
                if not sure and len(x) > 1 and (a.group()[0].isupper() != b.group()[0].isupper() or (kinds[0] or kinds[1]) == ("family" if bool(kinds[0]) != comma else "given")):
                    continue
                if len(x) == 1:
                    sure = kinds[1] in ("family", "both")
                add(a.start(), b.end(), x, y, sure, comma or kinds[0] == "family" or kinds[1] == "given")
    at = 0
    while m := _CAPITALS.search(text, at):
        ws = _WORDS.findall(m.group().lower())
        add(m.start(), m.end(), ws[0], ws[-1], False, "," in m.group())
        at = m.end() - len(ws[-1])  # the second word may begin the next pair


def candidates(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """texts: record_type, record_id, text. Rows of one id may carry different texts, told apart by text_key. Rows with a pii_type are candidate spans with their patterns; rows with a word
    tell how often a task saw it, beside candidates or not. The roster is read on the driver: a fixed table of some hundred
    parts by its definition; a part listed as both kinds is of either."""
    parts: dict[str, str] = {}
    for part, kind in roster.select("name_part", "part_kind").toLocalIterator():
        if part and len(part) > 1:
            p = part.strip().lower()
            parts[p] = kind if parts.get(p, kind) == kind else "both"
    shared = texts.sparkSession.sparkContext.broadcast(parts)
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.int64()]
    names = SPAN_SCHEMA.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            rows = []
            for kind, key, text_key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                own = _WORDS.findall(text.lower())
                words.update(own)
                for pii, first, end, sure, instance, given, family in spans_of(text, shared.value, own):
                    caps = given is not None and text[first].isupper() and instance.rsplit(" ", 1)[-1][:1] != text[end - len(instance.rsplit(" ", 1)[-1]) : end][:1]
                    if pii == "email" and sure:
                        words.subtract(_WORDS.findall(instance))
                    rows.append((kind, key, text_key, pii, first, end, sure, instance, given, family, caps, _around(text, first, end), None, None))
            if rows:
                yield batch_of(rows)
            if len(words) > 500_000:
                yield batch_of([(None,) * 12 + (w, n) for w, n in words.items()])
                words.clear()
        yield batch_of([(None,) * 12 + (w, n) for w, n in words.items()])

    return texts.select("record_type", "record_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, SPAN_SCHEMA)


def _name_parts(names: DataFrame, words: DataFrame, roster: DataFrame) -> DataFrame:
    """part, kind: the known parts and those found beside them, until a round finds no more. A word is taken for a part if much
    of all its use in the texts is beside known parts of the other kind, and of several different ones."""
    known = roster.select(F.lower(F.trim("name_part")).alias("part"), F.col("part_kind").alias("kind")).where(F.length("part") > 1).distinct()
    pairs = cut(names.groupBy("given", "family").agg(F.count("*").alias("n"), F.sum(F.col("caps").cast("int")).alias("caps")))
    initials = cut(pairs.select("given").where(F.length("given") == 1).distinct())
    had = -1
    while True:
        known = cut(known)
        have = known.count()
        if have == had:
            return known
        had, found = have, known
        for kind, other in (("given", "family"), ("family", "given")):
            partner = known.where(F.col("kind") == other).select(F.col("part").alias(other))
            partner = partner.unionByName(initials) if kind == "family" else partner
            near = pairs.join(partner, other).where(F.length(kind) > 2).groupBy(F.col(kind).alias("part")).agg(F.sum("n").alias("near"), F.sum("caps").alias("caps"), F.count("*").alias("partners"))
            reach = lambda share, partners: (F.col("partners") >= partners) & (F.col("near") >= share * F.col("count"))
            enough = reach(PART_SHARE, PART_PARTNERS) | reach(LOW_PART_SHARE, LOW_PART_PARTNERS)
            scored = near.join(words.withColumnRenamed("word", "part"), "part").where(enough & (2 * F.col("caps") >= F.col("near")))
            found = found.unionByName(scored.select("part", F.lit(kind).alias("kind")))
        known = found.distinct()


#: What a span is known by. A null id can't be joined on, so it goes by a name that no id has.
_SPAN = ["record_type", "record_id", "text_key", "pii_type", "first", "end"]
_NO_ID = "\x00"


def findings(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """record_type, record_id, text_key, pii_type, first, end, sure, instance: where (code points, end excluded) personal
    information is. Texts are read whole; null and empty texts have none; repeated rows of a record and text give its spans
    once, rows of one id with different texts keep theirs apart, and rows without an id are records like others."""
    listed = cut(candidates(texts, roster))
    spans = listed.where("pii_type is not null").drop("word", "count").withColumn("record_id", F.coalesce("record_id", F.lit(_NO_ID)))
    spans = cut(spans.dropDuplicates(_SPAN))
    names, others = spans.where("pii_type = 'name'"), spans.where("pii_type <> 'name'")
    used = cut(names.select(F.explode(F.array("given", "family")).alias("word")).groupBy("word").agg(F.count("*").alias("k")))
    words = cut(listed.where("word is not null").groupBy("word").agg(F.sum("count").alias("count")).join(used, "word"))
    parts = _name_parts(names, words.drop("k"), roster)
    # Words that are common outside of names can't be parts of one, whatever stands around them.
    common = words.where(F.col("k") < LOW_PART_SHARE * F.col("count"))
    flags = names
    for side in ("given", "family"):
        known = parts.where(F.col("kind") == side).select(F.col("part").alias(side), F.lit(True).alias(f"{side}_known"))
        plain = common.select(F.col("word").alias(side), F.lit(True).alias(f"{side}_plain"))
        flags = flags.join(known, side, "left").join(plain, side, "left")
    made = F.col("sure") | (F.col("family_known").isNotNull() & (F.col("given_known").isNotNull() | (F.length("given") == 1)))
    out = [*spans.columns, "ok", "plain"]
    flags = flags.withColumns({"ok": F.coalesce(made, F.lit(False)), "plain": F.col("given_plain").isNotNull() | F.col("family_plain").isNotNull()}).select(*out)
    state = cut(flags.unionByName(others.withColumns({"ok": F.col("sure"), "plain": F.lit(False)}).select(*out)))
    edge = ["pii_type", "pattern", "instance"]
    edges = state.select("ok", "pii_type", "instance", F.explode("patterns").alias("pattern")).groupBy(*edge).agg(F.max(F.col("ok").cast("int")).alias("ok"))
    edges, waiting = cut(edges), state.where("not ok and not plain")
    accepted = [state.where("ok")]
    while True:
        scores = edges.groupBy("pii_type", "pattern").agg(F.sum("ok").alias("good"), F.count("*").alias("n"))
        fits = (F.col("good") >= PATTERN_INSTANCES) & (F.col("good") >= PATTERN_SHARE * F.col("n"))
        strong = (F.col("good") >= STRONG_INSTANCES) & (F.col("good") >= STRONG_SHARE * F.col("n")) & ~F.col("pattern").rlike("\\^ \\^|\\$ \\$|^m")
        credible = scores.where(fits | strong).select("pii_type", "pattern", F.when(strong, 2).otherwise(1).alias("weight"))
        votes = waiting.select(*_SPAN, F.explode("patterns").alias("pattern")).join(credible, ["pii_type", "pattern"]).groupBy(*_SPAN).agg(F.sum("weight").alias("votes")).where("votes >= 2")
        found = cut(waiting.join(votes.drop("votes"), _SPAN, "left_semi"))
        if found.isEmpty():
            break
        accepted.append(found)
        waiting = cut(waiting.join(found.select(*_SPAN), _SPAN, "left_anti"))
        more = found.select(F.lit(1).alias("ok"), "pii_type", "instance", F.explode("patterns").alias("pattern")).select(*edge, "ok")
        edges = cut(edges.unionByName(more).groupBy(*edge).agg(F.max("ok").alias("ok")))
    every = accepted[0]
    for each in accepted[1:]:
        every = every.unionByName(each)
    return every.select("record_type", F.nullif("record_id", F.lit(_NO_ID)).alias("record_id"), "text_key", "pii_type", "first", "end", "sure", "instance")


def record_texts(learning_queue: DataFrame, session_messages: DataFrame) -> DataFrame:
    queue = learning_queue.select(F.lit("queue").alias("record_type"), F.col("id").alias("record_id"), F.col("transcript").alias("text"))
    return queue.unionByName(session_messages.select(F.lit("message").alias("record_type"), F.col("id").alias("record_id"), F.col("content").alias("text")))


def found_types(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """record_type, record_id, pii_type: once for each record and type in its text."""
    return findings(texts, roster).select("record_type", "record_id", "pii_type").distinct()


_PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with spans (first, end, type) replaced by placeholders; of overlapping spans the one that begins first, then
    the longest, counts, and the rest of the other goes with it."""
    out, at = [], 0
    for first, end, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if first < at:
            at = max(at, end)
            continue
        out += [text[at:first], _PLACEHOLDER[kind]]
        at = end
    return "".join(out) + text[at:]


def redacted(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """record_type, record_id, text_key, text of every distinct record and text, personal information replaced and all else
    unchanged. Rows of one id with different texts are different records, and so are rows without an id. Texts
    are shuffled once, to drop repeated rows; those without findings pass no Python."""
    found = cut(findings(texts, roster))
    key = ["record_type", "record_id", "text_key"]
    named = F.xxhash64("record_type", F.coalesce("record_id", F.lit(_NO_ID)), "text_key")
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    bits = bits_for(found.count())
    hit = may_be_in(texts.sparkSession, bit_table(found.select(named.alias("key")).distinct(), bits), bits, named)
    spans = found.groupBy("record_type", F.coalesce("record_id", F.lit(_NO_ID)).alias("record_id"), "text_key").agg(F.collect_list(F.struct("first", "end", "pii_type")).alias("spans"))
    replace = F.pandas_udf(lambda t, s: t.combine(s, lambda a, b: redact(a, [(x["first"], x["end"], x["pii_type"]) for x in b])), "string")
    marked = keyed.select(*key, "text", hit.alias("hit")).withColumn("record_id", F.coalesce("record_id", F.lit(_NO_ID)))
    one = marked.where("hit").dropDuplicates(key).join(spans, key, "left")
    changed = one.where("spans is not null and text is not null").select(*key, replace("text", "spans").alias("text"))
    same = one.where("spans is null or text is null").select(*key, "text")
    rest = marked.where("not hit").select(*key, "text").dropDuplicates(key)
    return rest.unionByName(same).unionByName(changed).withColumn("record_id", F.nullif("record_id", F.lit(_NO_ID)))
