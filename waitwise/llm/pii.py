"""PII surrogates, in DataFrame functions only.

Entities (e-mail addresses, phone, card and account numbers, IP addresses, secrets, titled person names)
are found by patterns and replaced by surrogates that a key and the entity alone decide: digits become digits,
vowels vowels and consonants consonants of the same script and case, letters and digits of any other script others
of that script (combining marks stay), given names come from a list of the same
gender and script, separators stay, a card number that passes its check digit still does. One entity has one
surrogate everywhere, however it is spaced or cased (coreference), and no two entities of a type share one,
nor is a surrogate any real entity of the corpus (collision checks over the distinct entities; losers derive
another surrogate until none collide).

Only distinct entities are shuffled for the checks. Documents are rewritten where they lie; those that may hold
an entity that collided (a bounded Bloom filter tells) are joined with its attempt number.

Edge cases: a null or empty text has no entities and stays; texts are read whole; repeated rows get the same
surrogates; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwise.llm.common import maybe_in

# Patterns of the entity types, in order of precedence: what may not stand before, the entity,
# what may not follow.
MALE_TITLES = "Mr|Sir|Lord|Herr|Señor|Sr|Monsieur|M|Г-н|господин|Κύριος|السيد|श्री|מר"
FEMALE_TITLES = "Mrs|Ms|Miss|Lady|Frau|Señora|Sra|Madame|Mme|Г-жа|госпожа|Κυρία|السيدة|श्रीमती|גברת"
#: A word of a name: capitalised, of a script without case, or of one that writes no spaces between words.
_WORD = r"(?:\p{Lu}[\p{L}\p{M}'’-]+|[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]{1,4}|\p{Lo}[\p{L}\p{M}'’-]*)"
_NAME = rf"\.? {_WORD}(?: {_WORD}){{0,2}}"
_LABEL = r"-*+[\p{L}\p{N}][\p{L}\p{M}\p{N}-]{0,62}"
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": (r"(?<![\p{L}\p{M}\p{N}._%+-])", rf"(?=[\p{{M}}._%+-]*+[\p{{L}}\p{{N}}])[\p{{L}}\p{{M}}\p{{N}}._%+-]++@{_LABEL}(?:\.{_LABEL}){{1,8}}", ""),
    "secret": (r"(?<![0-9A-Za-z])", r"(?:(?:AKIA|ASIA|akia|asia)[0-9A-Za-z]{16}|(?:sk|pk|ghp|SK|PK|GHP)[_-](?=[A-Za-z_-]*\d)[0-9A-Za-z_-]{16,}"
                                    r"|(?=[a-f]*\d)[0-9a-f]{32,128}|(?=[A-F]*\d)[0-9A-F]{32,128})", r"(?![0-9A-Za-z])"),
    "account": (r"(?<![0-9A-Za-z])", r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?", r"(?![0-9A-Za-z])"),
    "card": (r"(?<![\d.])", r"(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5})", r"(?!\.?\d)"),
    "ip6": (r"(?<![0-9A-Za-z:.])", rf"(?=[A-Fa-f:]*+\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)", r"(?![0-9A-Za-z:]|\.\d)"),
    "ip": (r"(?<![\d.])", r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)", r"(?!\.?\d)"),
    "ssn": (r"(?<![\d-])", r"\d{3}-\d{2}-\d{4}", r"(?![\d-])"),
    "phone": (r"(?<![\d+])", r"(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}"
                             r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2}){3,5}|0\d{1,3}(?:[ .-]\d{2}){3,4}|\+\d{8,15})", r"(?!\d)"),
    "person_f": (r"(?<![\p{L}\p{N}])", rf"(?:{FEMALE_TITLES}){_NAME}", ""),
    "person_m": (r"(?<![\p{L}\p{N}])", rf"(?:{MALE_TITLES}){_NAME}", ""),
}
ANY = "|".join(f"{before}{body}{after}" for before, body, after in PATTERNS.values())
#: Cheap test that a text without any entity fails.
HINT = rf"[0-9@]|(?:{MALE_TITLES}|{FEMALE_TITLES})\.? [\p{{Lu}}\p{{Lo}}]"

# Given names by script and gender, and letters by script.
GIVEN = {
    ("latin", "m"): "James Robert Michael David William Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George".split(),
    ("latin", "f"): "Mary Patricia Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Emily Donna Michelle Carol".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей Павел Олег Игорь Виктор Юрий Борис Роман Антон".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Вера Нина Галина Людмила Дарья София".split(),
}
ALPHABETS = {          # (members, letters to draw from)
    "vowel": ("aeiouy", "aeiou"), "consonant": ("bcdfghjklmnpqrstvwxz", "bcdfghjklmnprstvwz"),
    "accent_vowel": ("áàâäãåæéèêëíìîïóòôöõøœúùûüýÿ", "áàâäéèêëíìîïóòôöúùûü"), "accent_consonant": ("ßçñšžłńśźżčřďťň", "çñšžłńśźč"),
    "cyr_vowel": ("аеёиоуыэюя", "аеиоуыэюя"), "cyr_consonant": ("бвгджзйклмнпрстфхцчшщъь", "бвгджзклмнпрстфхцчш"),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψως", "αβγδεζηθικλμνξοπρστυφχψω"),
}
MAX_ROUNDS = 40


def _other_alphabets() -> tuple[list[str], list[int], list[str]]:
    """Alphabets (at most 256 letters each, the first for letters of small scripts), the alphabet of each column of
    16 code points (Unicode blocks are made of columns), and the digits in each column."""
    letters: dict[str, str] = {}
    column_of: dict[int, str] = {}
    digits: dict[int, str] = {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Nd":
            digits[code >> 4] = digits.get(code >> 4, "") + c
        elif kind[0] == "L":
            script = unicodedata.name(c, "OTHER").split()[0]
            column_of.setdefault(code >> 4, script)
            # only what upper() and lower() keep one character
            if kind in ("Ll", "Lo") and c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c and unicodedata.normalize("NFC", c) == c:
                letters[script] = letters.get(script, "") + c
    letters = {k: v[:256] for k, v in letters.items() if len(v) >= 16}
    names = list(letters)
    numbers = [names.index(column_of[i]) + 2 if column_of.get(i) in letters else 1 for i in range(0x1000)]
    return [ALPHABETS["consonant"][1], *letters.values()], numbers, [digits.get(i, "") for i in range(0x1000)]


OTHER_ALPHABETS, OTHER_COLUMNS, OTHER_DIGITS = _other_alphabets()



def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (a let, by way of a one-element array)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entity_type(e: Column) -> Column:
    """First type whose pattern fits the whole entity."""
    out: Column = F.lit(None).cast("string")
    for name, (_, body, _) in reversed(PATTERNS.items()):
        out = F.when(e.rlike(f"^(?:{body})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, e: Column) -> Column:
    """What entities of one identity share: digits of numbers, lower case of the rest without its title."""
    low = F.lower(e)
    return (F.when(kind.isin("card", "ssn"), F.regexp_replace(e, r"\D", ""))
            .when(kind == "phone", F.regexp_replace(e, r"[^0-9+]", ""))
            .when(kind == "account", F.regexp_replace(low, " ", ""))
            .when(kind.startswith("person"), F.regexp_replace(low, r"^\S+ ", "")).otherwise(low))


def _stream(key: str, kind: Column, text: Column, attempt: Column) -> Column:
    """Keyed hex digits, two for each character of ``text``."""
    seed = F.concat_ws("|", F.lit(key), kind, text, attempt.cast("string"))
    blocks = F.sequence(F.lit(0), F.floor(F.char_length(text) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 256)), "")


def _draw(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _draw_like(c: Column, n: Column) -> Column:
    """Another letter or digit of the script of ``c``, for those that ``ALPHABETS`` does not list."""
    column = F.floor(F.ascii(c) / 16).cast("int") + 1
    in_plane = column <= len(OTHER_COLUMNS)
    number = F.when(in_plane, F.element_at(F.from_json(F.lit(str(OTHER_COLUMNS)), "array<int>"), column)).otherwise(1)
    digits = F.when(in_plane, F.element_at(F.split(F.lit("|".join(OTHER_DIGITS)), r"\|"), column)).otherwise("")
    letters = F.element_at(F.split(F.lit("|".join(OTHER_ALPHABETS)), r"\|"), number)
    def of(known: Column) -> Column:
        return _bound(known, lambda x: F.substring(x, F.pmod(n, F.char_length(x)) + 1, F.lit(1)))
    return (F.when(c.rlike(r"\p{L}"), of(letters))
            .when(c.rlike(r"\p{N}"), of(F.when(c.rlike(r"\p{Nd}") & (F.char_length(digits) > 0), digits).otherwise("0123456789"))).otherwise(c))


def _substitute(text: Column, stream: Column, hex_only: Column) -> Column:
    """Each digit, letter or hex digit by another of its kind; everything else stays (marks, separators)."""
    def letter(c: Column, n: Column) -> Column:
        new = F.when(c.rlike("[0-9]"), F.when(hex_only & (n % 16 > 9), _draw("abcdef", n)).otherwise(_draw("0123456789", n)))
        new = new.when(hex_only & c.rlike("[a-f]"), _draw("0123456789abcdef", n))
        for members, letters in ALPHABETS.values():
            new = new.when(F.instr(F.lit(members), c) > 0, _draw(letters, n))
        return new.otherwise(F.when(c > F.lit("\x7f"), _draw_like(c, n)).otherwise(c))

    def swap(s: Column) -> Column:
        def one(i: Column) -> Column:
            here = F.struct(F.substring(text, i, F.lit(1)).alias("c"),
                            F.conv(F.substring(s, i * 2 - 1, F.lit(2)), 16, 10).cast("int").alias("n"))
            return _bound(here, lambda x: letter(x["c"], x["n"]))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(text)), one), "")

    return F.when(F.char_length(text) > 0, _bound(stream, swap)).otherwise(F.lit(""))


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10 of a string of digits, doubling every second from the right."""
    n = F.char_length(digits)
    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x) % 10


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Canonical surrogate of a canonical entity."""
    stream = _stream(key, kind, canon, attempt)

    def octets(s: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(
            F.conv(F.substring(s, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(254)).cast("string")), ".")

    def groups(s: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(s, i * 4 + 1, F.lit(4))), ":")

    def fit(swapped: Column) -> Column:
        n = F.char_length(swapped)
        # cards keep the residue of their check sum: a valid number stays valid
        last = F.pmod(F.substring(swapped, n, F.lit(1)).cast("int") + _luhn(canon) - _luhn(swapped), F.lit(10))
        tail = F.regexp_extract(canon, r"(\.[^.]*)$", 1)       # a top-level domain stays
        code = F.regexp_extract(canon, r"^\+(?:[17]|\d\d)", 0)
        return (F.when(kind == "card", F.concat(F.substring(swapped, F.lit(1), n - 1), last.cast("string")))
                .when(kind == "email", F.concat(F.substring(swapped, F.lit(1), n - F.char_length(tail)), tail))
                .when(kind == "phone", F.concat(code, F.substring(swapped, F.char_length(code) + 1, n)))
                .when(kind == "account", F.concat(F.substring(canon, 1, 2), F.substring(swapped, F.lit(3), n)))
                .otherwise(swapped))

    return (F.when(kind == "ip", _bound(stream, octets)).when(kind == "ip6", _bound(stream, groups)).when(kind.startswith("person"), _person(key, kind, canon, attempt))
            .otherwise(_bound(_substitute(canon, stream, kind == "secret"), fit)))


def _person(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Given names by list (same gender and script), the family name letter by letter, each keyed by itself,
    so a family name alone corefers with the full name; an attempt past the first changes the family name."""
    words = F.split(canon, " ")
    n = F.size(words)

    def one(w: Column, i: Column) -> Column:
        number = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("given"), w), 256), 1, 6), 16, 10).cast("int")
        given: Column = F.lit(None).cast("string")
        for (script, sex), names in GIVEN.items():
            is_script = w.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else w.rlike(r"\p{IsLatin}")
            pick = F.element_at(F.array(*[F.lit(x.lower()) for x in names]), F.pmod(number, F.lit(len(names))) + 1)
            given = F.when(is_script & (kind == f"person_{sex}"), pick).otherwise(given)
        family = _substitute(w, _stream(key, F.lit("family"), w, attempt), F.lit(False))
        return F.when((i < n - 1) & given.isNotNull(), given).otherwise(family)

    return F.array_join(F.transform(words, one), " ")


def render(kind: Column, e: Column, sur: Column) -> Column:
    """A canonical surrogate in the form of one occurrence: its separators, title and upper case."""
    spaced = kind.isin("card", "ssn", "phone", "account")
    shouted = (e == F.upper(e)) & (e != F.lower(e))

    def one(i: Column) -> Column:
        c = F.substring(e, i, F.lit(1))
        kept = F.char_length(F.regexp_replace(F.substring(e, F.lit(1), i), r"[^\p{L}\p{N}+]", ""))
        new = F.substring(sur, kept, F.lit(1))
        return F.when(c.rlike(r"[^\p{L}\p{N}+]"), c).otherwise(F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new))

    name = F.concat(F.regexp_extract(e, r"^(\S+ )", 1), F.when(shouted, F.upper(sur)).otherwise(F.initcap(sur)))
    return (F.when(spaced, F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(e)), one), ""))
            .when(kind.startswith("person"), name).when(shouted, F.upper(sur)).otherwise(sur))


def find_entities(text: Column) -> Column:
    """Entities of a text in order, as written."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def described(entities: Column) -> Column:
    """Array of (raw, kind, canon) of an array of entities."""
    def typed(e: Column) -> Column:
        return F.struct(e.alias("raw"), entity_type(e).alias("kind"))
    return F.transform(F.transform(entities, typed),
                       lambda t: F.struct(t["raw"].alias("raw"), t["kind"].alias("kind"), canonical(t["kind"], t["raw"]).alias("canon")))


def _id(kind: Column, canon: Column) -> Column:
    return F.concat_ws(":", kind, canon)


def collided(docs: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate is another's or a real entity of the corpus.

    Rounds of one aggregation over the distinct entities and their surrogates; in a round, the surrogate's
    owner of most attempts keeps it (ties: the larger entity), the others and those that hit a real entity
    derive their next one.
    """
    one = (docs.filter(F.col("text").rlike(HINT)).select(F.explode(described(find_entities(F.col("text")))).alias("e"))
           .select("e.kind", "e.canon"))
    real = one.groupBy("kind", "canon").agg(F.lit(0).alias("attempt")).checkpoint()
    for _ in range(MAX_ROUNDS):
        made = real.withColumn("sur", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        # the same (kind, name) as a real entity, or as several surrogates
        sides = (made.select(_family(F.col("kind")).alias("kind"), F.col("sur").alias("name"),
                             F.struct("attempt", "canon", F.col("kind").alias("of")).alias("owner"))
                 .unionByName(made.select(_family(F.col("kind")).alias("kind"), F.col("canon").alias("name"),
                                          F.lit(None).cast("struct<attempt:int,canon:string,of:string>").alias("owner"))))
        bad = (sides.groupBy("kind", "name").agg(F.count("owner").alias("n"), F.count(F.lit(1)).alias("all"), F.max("owner").alias("keeper"))
               .filter((F.col("n") > 0) & (F.col("all") > 1))
               .select(F.col("kind").alias("family"), F.col("name").alias("sur"), F.when(F.col("all") == F.col("n"), F.col("keeper")).alias("keeper")))
        losers = (made.withColumn("family", _family(F.col("kind"))).join(bad, ["family", "sur"])
                  .filter(F.col("keeper").isNull() | (F.col("keeper.canon") != F.col("canon")) | (F.col("keeper.of") != F.col("kind")))
                  .select("kind", "canon", F.lit(1).alias("more")).checkpoint())
        if losers.isEmpty():
            return real.filter("attempt > 0")
        real = (real.join(losers, ["kind", "canon"], "left")
                .select("kind", "canon", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")).checkpoint())
    raise RuntimeError("surrogates still collide; the space of some entity type is full")


def _family(kind: Column) -> Column:
    """Types that must not share a surrogate: all person names are one."""
    return F.when(kind.startswith("person"), "person").otherwise(kind)


def rewritten(text: Column, key: str, attempts: Column | None) -> Column:
    """The text with its entities replaced; ``attempts`` maps an entity's id to its attempt number."""
    def one(e: Column) -> Column:
        n = F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, _id(e["kind"], e["canon"])), F.lit(0))
        return _bound(surrogate(key, e["kind"], e["canon"], n), lambda sur: render(e["kind"], e["raw"], sur))

    new = F.concat(F.transform(described(find_entities(text)), one), F.array(F.lit("")))
    pieces = F.zip_with(F.split(text, ANY, -1), new, lambda a, b: F.concat(a, b))
    return F.when(text.rlike(HINT), F.array_join(pieces, "")).otherwise(text)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, plus n_entities; all other columns as given."""
    fixes = collided(docs, key)
    count = F.when(F.col("text").rlike(HINT), F.size(find_entities(F.col("text")))).otherwise(F.lit(0))
    counted = docs.drop("n_entities").withColumn("n_entities", F.coalesce(count, F.lit(0)).cast("long"))
    if fixes.isEmpty():
        return counted.withColumn("text", rewritten(F.col("text"), key, None))
    # texts with an entity that collided, by the hash of the text, and the attempts of those entities
    found = (docs.filter(F.col("text").rlike(HINT)).select(F.xxhash64("text").alias("__t"), F.explode(described(find_entities(F.col("text")))).alias("e"))
             .select("__t", "e.kind", "e.canon").join(fixes, ["kind", "canon"]).distinct()
             .groupBy("__t").agg(F.map_from_entries(F.collect_set(F.struct(_id(F.col("kind"), F.col("canon")), F.col("attempt")))).alias("__fix"))
             .checkpoint())
    hit = maybe_in(found, "__t", F.xxhash64("text"))
    sure = counted.filter(~hit).withColumn("text", rewritten(F.col("text"), key, None))
    unsure = (counted.filter(hit).withColumn("__t", F.xxhash64("text")).join(found, "__t", "left")
              .withColumn("text", rewritten(F.col("text"), key, F.coalesce("__fix", F.create_map().cast("map<string,int>")))))
    return sure.unionByName(unsure.select(*sure.columns))
