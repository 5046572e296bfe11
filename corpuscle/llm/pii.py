"""Personal information in texts (problem 5): typed spans, and keyed surrogates in their place."""

from __future__ import annotations

import hashlib
import hmac
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import messages, read, staged

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
#: Endings of a domain that is spelt out; in a written address any ending of letters counts.
ENDINGS = "com|net|org|example|test|invalid|info|biz|edu|gov|io|eu|uk|de|fr|es|it|pl|ro|pt|ru|nl|us"
#: Kinds of streets that follow the name, and those that precede it, as written in the languages of the corpus.
STREET_AFTER = "road|rd|street|st|lane|ln|avenue|ave|way|close|gardens|gdns|crescent|cres|drive|dr|court|ct|terrace|place|pl|square|sq|grove|mews|hill|row|walk|parade|boulevard|blvd"
STREET_JOINED = "straße|strasse|str\\.|weg|gasse|allee|platz|ufer|damm|straat|laan|gatan|vägen|gata"
STREET_BEFORE_NUMBER_FIRST = "rue|avenue|av\\.|boulevard|bd|chemin|impasse|allée|quai|place|cours"
STREET_BEFORE = "calle|c/|avenida|avda\\.|paseo|plaza|via|viale|piazza|corso|rua|travessa|largo|praça|ul\\.|ulica|al\\.|aleja|os\\.|pl\\.|plac|strada|str\\.|bulevardul|ул\\.|улица|пр\\.|проспект"
TITLES = "mr|mrs|ms|miss|dr|prof|sir|herr|frau|mme|mlle|señor|señora|sr|sra|pan|pani|doamna|domnul"
#: Words that stand before a family name without being a given name.
NO_GIVEN = frozenset("met for is under regards and or with from by to of the a at on in said ask this booked mister call ring ok hi hey hiya re dear thanks sorry morning right so lol btw der die das von le la el los les sur chez con avec mit family house old new upper lower".split())

_X = regex.VERBOSE | regex.IGNORECASE
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
EMAIL = regex.compile(
    rf"""(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*
    (?: @{_LABEL}(?:\.{_LABEL})*\.\p{{L}}{{2,}}(?![\p{{L}}\p{{N}}-]) | {_AT}{_LABEL}(?:{_DOT}{_LABEL})*?{_DOT}(?:{ENDINGS})(?:{_DOT}(?:{ENDINGS}))?(?![\p{{L}}\p{{N}}-]) )""",
    _X,
)
IDENTITY = regex.compile(
    r"""(?<![\p{L}\p{N}])(?: [a-z]{2}[\s-]?\d\d[\s-]?\d\d[\s-]?\d\d[\s-]?[a-d] | \d{3}[\s-]\d\d[\s-]\d{4} | \d{8}[\s-]?[a-z] | [xyz][\s-]?\d{7}[\s-]?[a-z] )(?![\p{L}\p{N}])(?!-\d)""",
    _X,
)
_RUN = regex.compile(r"(?<![\p{L}\p{N}.:/£$€+-])(?<![\p{N}]\()(?:\+|\((?=\+?\d{1,5}\)))?\d(?:[\d]|[ .\-/ ]{1}(?=[\d(])|[ ]?\((?=\d{1,5}\))|(?<=\d)\)[ .\-/]?(?=\d))*(?![\p{L}\p{N}])")
_NUMBER = r"\d{1,4}(?:\s?[a-z](?![\p{L}]))?"
_FLAT = r"(?:(?:flat|apt\.?|apartment|unit|suite|wohnung|piso|appt\.?)\s\#?\d+[a-z]?,?\s)?"
_NAME = r"(?:(?:upper|lower|old|new|great|little|north|south|east|west|high|[nsew]\.)\s)?[\p{L}][\p{L}'’-]+"
NUMBER_FIRST = regex.compile(
    rf"""(?<![\p{{L}}\p{{N}}:.,/£$€-])(?:
      {_FLAT}{_NUMBER},?\s{_NAME}\s(?:{STREET_AFTER})(?![\p{{L}}\p{{N}}])
    | {_FLAT}\d{{1,4}}(?:\s?(?:bis|ter|[a-d]))?,?\s(?:{STREET_BEFORE_NUMBER_FIRST})\s(?:(?:de\sla|de\sl['’]|des|du|de|d['’])\s?)?[\p{{L}}][\p{{L}}'’-]+
    )""",
    _X,
)
NUMBER_JOINED = regex.compile(rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}][\p{{L}}-]*(?:{STREET_JOINED}),?\s\d{{1,4}}(?:\s?[a-z](?!\p{{L}}))?(?![\p{{L}}\p{{N}}])", regex.IGNORECASE)
NUMBER_LAST = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{STREET_BEFORE})\s(?:(?:de\slas|de\slos|de\sla|del|della|dei|da|do|de)\s)?[\p{{L}}][\p{{L}}'’-]+(?:,\s|\s|,)(?:(?:nr|n[.º°]|no|д)\.?\s)?\d{{1,4}}(?:/\d+)?(?:\s?[a-z](?!\p{{L}}))?(?![\p{{L}}\p{{N}}])", regex.IGNORECASE)
_JOINED = tuple(x.replace("\\", "") for x in STREET_JOINED.split("|"))
#: German streets named after a place; capitals tell them from the verb and the hour.
_AT_PLACE = regex.compile(r"(?<![\p{L}\p{N}])(?:A[mn]|AM|AN|(?<=(?:adresse: |party at |come to |deliver to: |live at |drop it at ))am)\s(?:(?:der|den|dem|DER|DEN|DEM)\s)?(?:\p{Lu}|(?<= am )\p{L})[\p{L}-]+,?\s\d{1,4}[a-z]?(?![\p{L}\p{N}:])")
#: Streets whose ending marks the whole: a number must precede, so that words which end alike are none.
_DIGIT = regex.compile(r"\d")
#: The least that an identity or telephone number holds: digits with no more than brackets or blanks between.
_DIGITS = regex.compile(r"(?:\d[\s().\-/ ]{0,3}){6}")
_NO_DIGIT = regex.compile(r"\D")
_LOCAL = regex.compile(r"(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}")
_WORD = regex.compile(r"\p{L}[\p{L}'’]*")


def phone_spans(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits that are full numbers: 10 to 14 digits after a plus sign or two zeros, 10 or 11 after one zero, or
    three, three and four. The longest such beginning of a run counts."""
    for m in _RUN.finditer(text):
        start, run = m.start(), m.group()
        ends = [k for k in range(len(run), 0, -1) if run[k - 1].isdigit() and (k == len(run) or not run[k].isdigit())]
        for k in ends:
            part = run[:k]
            if part.count("(") != part.count(")"):
                continue
            digits = _NO_DIGIT.sub("", part)
            n = len(digits)
            if part[0] == "+" or digits.startswith("00") or part.startswith("(+"):
                good = 10 <= n <= 15
            elif digits[0] == "0":
                good = 10 <= n <= 11
            else:
                good = bool(_LOCAL.fullmatch(part)) and digits[-10] in "23456789"
            if good:
                yield start, start + k
                break


class Names:
    """Finds persons by a list of name parts that is incomplete: given names as listed, family names as listed or
    composed of a beginning and an ending that each stand in several listed ones."""

    LEAST = 5

    def __init__(self, given, family):
        self.given = {g.casefold() for g in given}
        self.family = {f.casefold() for f in family}
        endings, beginnings = defaultdict(set), defaultdict(set)
        for f in self.family:
            for k in range(3, len(f) - 1):
                endings[f[k:]].add(f[:k])
                beginnings[f[:k]].add(f[k:])
        good = {e for e, b in endings.items() if len(b) >= self.LEAST}
        self.beginnings = {b for b, e in beginnings.items() if len(e & good) >= self.LEAST}
        self.endings = {e for e in good if len(endings[e] & self.beginnings) >= self.LEAST}
        #: What every family name found ends in, to pass over texts without one.
        self.tails = self.endings | {f[-4:] for f in self.family if not any(f.endswith(e) for e in self.endings)}
        self.known: dict[str, bool] = {}
        word = r"\p{L}[\p{L}'’]+"
        self.words = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._%+-])({word})(?:-({word}))?")
        self.mailbox = regex.compile(r"[\p{L}\p{N}_]|[.+-]?[\p{L}\p{N}+.-]*(?:@|\s?[\[(]at[\])])")
        self.full = regex.compile(rf"(?<![\p{{L}}\p{{N}}])({word}(?:-{word})?)[ \xa0](?:\p{{L}}\.[ \xa0]?)?$")
        self.initial = regex.compile(r"(?<![\p{L}\p{N}])\p{L}\.\s?(?:\p{L}\.\s?)?$")
        self.title = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.?\s$", regex.IGNORECASE)
        self.after = regex.compile(rf",\s({word}|\p{{L}}\.)(?:\s\p{{L}}\.)?(?![\p{{L}}\p{{N}}])")
        self.street = regex.compile(rf"\s(?:{STREET_AFTER})(?![\p{{L}}\p{{N}}])", regex.IGNORECASE)

    def is_family(self, word: str) -> bool:
        got = self.known.get(word)
        if got is None:
            w = word.casefold()
            got = w in self.family or any(w[:k] in self.beginnings and w[k:] in self.endings for k in range(3, len(w) - 1))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = got
        return got

    def _begin(self, text: str, low: int, start: int) -> tuple[int, bool] | None:
        """Where a name begins whose family name begins at ``start``, by what stands before it: a title, which is not
        part of it, a given name or an initial; and whether that is beyond doubt."""
        low = max(low, start - 60)
        head = text[low:start]
        if self.title.search(head):
            return start, True
        full = self.full.search(head)
        if full and full[1].casefold() not in NO_GIVEN and not self.is_family(full[1].split("-")[0]):
            return low + full.start(), full[1].casefold() in self.given
        initial = self.initial.search(head)
        return (low + initial.start(), True) if initial else None

    def _turned(self, text: str, m) -> int | None:
        """Where a name ends that goes on after its family name with a comma and a given name."""
        a = self.after.match(text, m.end())
        if not a:
            return None
        other = a[1].casefold()
        listed = other in self.given
        if listed or (a[1][:1].isupper() and other not in NO_GIVEN and a[1][:2].isupper() == m[1][:2].isupper()):
            # a given name with a family name of its own is another person
            rest = self.words.match(text, a.end() + 1)
            if not (rest and self.is_family(rest[1])):
                return a.end()
        return None

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        folded = text.casefold()
        if not any(t in folded for t in self.tails):
            return
        used = 0
        for m in self.words.finditer(text):
            if m.start() < used or not self.is_family(m[1]) or (m[2] and not self.is_family(m[2])) or self.mailbox.match(text, m.end()) or self.street.match(text, m.end()):
                continue
            begin, sure = self._begin(text, used, m.start()) or (None, False)
            end = None if sure else self._turned(text, m)
            if begin is not None and (end is None or text[end - 1] == "." or self.after.match(text, m.end())[1].casefold() not in self.given):
                used = m.end()
                yield begin, used
            elif end is not None:
                used = end
                yield m.start(), used


def find(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every piece of personal information of a text of any length, in order, none in another.
    A null or empty text has none."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []

    def add(spans, kind):
        for s, e in spans:
            if all(e <= a or s >= b for a, b, _ in taken):
                taken.append((s, e, kind))

    folded = text.casefold()
    if "@" in text or ("at" in folded and "dot" in folded) or "at)" in folded or "at]" in folded:
        add((m.span() for m in EMAIL.finditer(text)), "email")
    if _DIGIT.search(text):
        if _DIGITS.search(text):
            add((m.span() for m in IDENTITY.finditer(text)), "identity_number")
            add(phone_spans(text), "phone")
        add((m.span() for m in NUMBER_FIRST.finditer(text)), "street_address")
        if any(x in folded for x in _JOINED) or "strasse" in folded:
            add((m.span() for m in NUMBER_JOINED.finditer(text)), "street_address")
        add((m.span() for m in NUMBER_LAST.finditer(text)), "street_address")
        add((m.span() for m in _AT_PLACE.finditer(text)), "street_address")
    add(names.spans(text), "person_name")
    return sorted(taken)


def lexicon(spark, sf_dir: str) -> tuple[list[str], list[str]]:
    """Given and family names of ``name_lexicon``, a fixed table of a few hundred rows."""
    rows = read(spark, sf_dir, "name_lexicon").where("name is not null").select("name", "name_part").distinct().collect()
    return [r[0] for r in rows if r[1] == "given"], [r[0] for r in rows if r[1] == "family"]


def spans_of(spark, sf_dir: str) -> DataFrame:
    """(id, start, end, kind, found_text) of every piece, an id once."""
    given, family = lexicon(spark, sf_dir)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(given, family)
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(i, s, e, k, t[s:e]) for s, e, k in find(t, names)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "start", "end", "kind", "found_text"])

    return messages(spark, sf_dir).mapInArrow(detect, "id string, start int, end int, kind string, found_text string").distinct()


def p5_found(spark, sf_dir: str) -> DataFrame:
    """(id, kind, found_text): every piece of personal information, one that a text holds twice once."""
    return spans_of(spark, sf_dir).select("id", "kind", "found_text").distinct()


def p5_masked(spark, sf_dir: str) -> DataFrame:
    """(id, text): every message that holds personal information, with a placeholder such as [EMAIL] for each piece."""
    given, family = lexicon(spark, sf_dir)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(given, family)
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if spans := find(t, names):
                    ids.append(i)
                    texts.append(rebuilt(t, [(s, e, f"[{k.upper()}]") for s, e, k in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "text"])

    return messages(spark, sf_dir).mapInArrow(mask, "id string, text string").distinct()


def rebuilt(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, new in sorted(spans):
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


#: Given names put in the place of others, by gender; a listed name keeps its own gender.
WOMEN = ("Agatha", "Brenda", "Carla", "Doris", "Emma", "Flora", "Greta", "Hilda", "Iris", "Joan", "Karin", "Lena", "Marta", "Nora", "Opal", "Ruth", "Susan", "Tessa", "Ursula", "Wanda")
MEN = ("Adam", "Bruno", "Carl", "David", "Erik", "Frank", "George", "Henry", "Ivan", "James", "Karl", "Louis", "Mark", "Nils", "Otto", "Paul", "Ralph", "Samuel", "Tom", "William")
#: Given names of women that do not end in a.
_WOMEN_ELSE = frozenset("alice beatrice estelle helen ingrid mei miriam rosalind judith irene ngozi maud ruth".split())
_MEN_ELSE = frozenset("joshua luca andrea nikita".split())
_FAMILY = (("Ash", "Birch", "Cold", "Dun", "Fair", "Glen", "Hart", "Kings", "Long", "Mill", "North", "Oak", "Rad", "Stock", "Wood"), ("bourne", "church", "den", "field", "ham", "land", "leigh", "port", "side", "ton", "water", "well"))


def entity(kind: str, found: str) -> str:
    """What a piece names, whatever its writing: pieces of one entity get one surrogate."""
    folded = found.casefold()
    if kind == "email":
        folded = regex.sub(r"\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+", "@", folded)
        folded = regex.sub(r"\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+", ".", folded)
        return regex.sub(r"\s", "", folded)
    if kind == "phone":
        digits = regex.sub(r"\(0\)|\D", "", folded)
        return regex.sub(r"^(?:00)?44(?=\d{10}$)|^0(?=\d{10}$)|^1(?=\d{10}$)", "", digits)
    if kind == "person_name" and "," in folded:
        folded = " ".join(reversed([p.strip() for p in folded.split(",", 1)]))
    return regex.sub(r"[^\p{L}\p{N}]+", " " if kind in ("person_name", "street_address") else "", folded).strip()


def _stream(key: bytes, kind: str, what: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(key, f"{kind}\x1f{what}\x1f{attempt}\x1f{block}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        block += 1


def _like(model: str, new: str) -> str:
    return new.upper() if model.isupper() and len(model) > 1 else new.lower() if model.islower() else new


def _scrambled(text: str, bytes_: Iterator[int], keep: int = 0) -> str:
    """Digits for digits and letters for letters of the same script and case, the first ``keep`` of them kept."""
    out = []
    for c in text:
        if c.isdecimal():
            if keep > 0:
                keep -= 1
                out.append(c)
            else:
                out.append(chr(ord(c) - int(c) + next(bytes_) % 10))
        elif "a" <= c.lower() <= "z":
            out.append(_like(c * 2, chr(97 + next(bytes_) % 26)) if not c.isupper() else chr(65 + next(bytes_) % 26))
        else:
            out.append(c)
    return "".join(out)


def core(kind: str, what: str, key: bytes, attempt: int) -> str:
    """The keyed surrogate of an entity, without the writing of any piece."""
    b = _stream(key, kind, what, attempt)
    pick = lambda options: options[(next(b) * 256 + next(b)) % len(options)]
    family = lambda: pick(_FAMILY[0]) + pick(_FAMILY[1])
    if kind == "email":
        return f"{pick(WOMEN + MEN).lower()}.{family().lower()}{next(b)}{next(b)}@example.org"
    if kind == "phone":
        return "".join(str(next(b) % 10) for _ in range(7))
    if kind == "identity_number":
        return _scrambled(what, b)
    if kind == "street_address":
        return _scrambled(regex.sub(r"\D", "", what), b) + "|" + family() + pick(_FAMILY[1])
    first = what.split(" ")[0]
    women = first in _WOMEN_ELSE or (first.endswith("a") and first not in _MEN_ELSE)
    return f"{pick(WOMEN if women else MEN)} {family()}-{family()}"


def written(kind: str, found: str, made: str) -> str:
    """The surrogate ``made`` in the writing of the piece ``found``: its format, order and case."""
    if kind == "phone":
        digits = [k for k, c in enumerate(found) if c.isdigit()]
        out = list(found)
        for k, d in zip(reversed(digits), reversed(made), strict=False):
            out[k] = d
        return "".join(out)
    if kind == "identity_number":
        new = iter(made)
        return "".join(_like(c, next(new, c)) if c.isalnum() and not c.isupper() else next(new, c).upper() if c.isalnum() else c for c in found)
    if kind == "email":
        box, host = made.split("@")
        spelt = regex.search(r"(\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+|\s?@\s?)", found, regex.IGNORECASE)
        dot = regex.search(r"\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+", found, regex.IGNORECASE)
        return _like(found, box + (spelt[0] if spelt else "@") + host.replace(".", dot[0] if dot else "."))
    if kind == "street_address":
        digits, name = made.split("|")
        new, named = iter(digits), [False]

        def word(m):
            w = m[0]
            if named[0] or len(w) < 4 or regex.fullmatch(rf"(?:{STREET_AFTER}|{STREET_BEFORE}|{STREET_BEFORE_NUMBER_FIRST}|flat|unit|upper|lower)", w, regex.IGNORECASE):
                return w
            named[0] = True
            tail = regex.search(rf"(?:{STREET_JOINED})$", w, regex.IGNORECASE)
            return _like(w, name) + (tail[0] if tail else "")

        return _WORD.sub(word, regex.sub(r"\d", lambda m: next(new, m[0]), found))
    given, family = made.split(" ")
    if " " not in found and "," not in found and "." not in found:
        new = family if "-" in found else family.split("-")[0]
    elif "," in found:
        new = f"{family}, {given}"
    elif regex.match(r"\p{L}\.", found):
        new = f"{given[0]}. {family}"
    else:
        new = f"{given} {family}"
    return _like(regex.sub(r"[^\p{L}]", "", found), new)


def surrogates(spark, sf_dir: str, key: bytes = b"corpuscle") -> tuple[DataFrame, DataFrame]:
    """(spans with ``entity``, (kind, entity, made)): a keyed surrogate for each distinct entity of all messages.

    Two entities never share one: where they would, all but the smallest draw again, until none is left.
    """
    as_entity = F.udf(entity, "string")
    spans = staged(spans_of(spark, sf_dir).withColumn("entity", as_entity("kind", "found_text")))
    table = staged(spans.select("kind", "entity").distinct().withColumn("attempt", F.lit(0)))
    draw = F.udf(lambda kind, what, attempt: core(kind, what, key, attempt), "string")
    while True:
        drawn = staged(table.withColumn("made", draw("kind", "entity", "attempt")))
        # a shared surrogate's group is small, as draws are uniform; its smallest entity keeps it
        place = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "entity"))
        ranked = staged(drawn.withColumn("place", place))
        if ranked.where("place > 1").isEmpty():
            return spans, ranked.select("kind", "entity", "made")
        table = staged(ranked.select("kind", "entity", F.when(F.col("place") > 1, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt")), table)


def p5_surrogates(spark, sf_dir: str) -> DataFrame:
    """(id, text): every message that holds personal information, with each piece replaced by the surrogate of its
    entity in the writing of the piece. The same person, number or address is the same everywhere."""
    spans, table = surrogates(spark, sf_dir)
    write = F.udf(written, "string")
    new = spans.join(table, ["kind", "entity"]).select("id", "start", "end", write("kind", "found_text", "made").alias("new"))
    # a text bounds its spans
    lists = new.groupBy("id").agg(F.collect_list(F.struct("start", "end", "new")).alias("spans"))
    build = F.udf(lambda t, spans: rebuilt(t, [tuple(s) for s in spans]), "string")
    return messages(spark, sf_dir).distinct().join(lists, "id").select("id", build("text", "spans").alias("text"))
