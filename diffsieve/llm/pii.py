"""PII surrogates in DataFrame operations only (operator 8).

Entities are found by ``KINDS``: a pattern each, the first that matches at a place wins. An entity
is known by kind and canonical value (digits of phone and card numbers, lower-cased
mail addresses, the value behind a ``password=`` label, single names of a person). Each
gets a replacement drawn from a keyed hash: same length, letter classes and script (outside the
scripts of ``CLASSES``: same 128 characters), valid card
check digits where the original's are, address classes of IPs, first names of the title's gender.

``dictionary`` makes the replacements of all distinct entities at once and checks them:
two entities of a kind never share a replacement and none equals an entity of the data; the loser
draws again until nothing collides. Names get longer from draw to draw; whatever still collides after
``SAME`` draws of its own shape gets further digits, a private address another private range and
at last one of IPv6. So the choice never runs out. Equal entities stay equal in all texts, and different
ones different. Texts without entities never meet the dictionary; of the others each is joined
with its own entities only (a hot entity's rows are dealt by text, and pre-aggregated before).

Defined results: null stays null, text without entities stays as it is; separators and case of an
occurrence are kept; a name behind a title is replaced at every capitalised mention in its text, with or
without the title; repeated rows are treated alike; extra columns pass through; texts are
read whole, by patterns that don't backtrack over long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import read, saved

DEFAULT_KEY = "surrogates-1"
#: Draws of an entity's own length and range before it may grow.
SAME = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LABEL = r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?"
#: Titles by gender, as plain words.
MALE = "Mr|Sir|Herr|Monsieur|Señor|Sr|Signor|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Lady|Frau|Madame|Mme|Mlle|Señora|Sra|Signora|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof"
MALE, FEMALE, NEUTRAL = (f"{titles}|{titles.upper()}" for titles in (MALE, FEMALE, NEUTRAL))
_NAME = r"\p{Lu}[\p{L}'’-]++"
#: kind -> pattern, in order of precedence.
KINDS = {
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,24}",
    "login": r"://[^\s/:@]{1,64}+:[^\s/@]{1,64}+@",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])",
    "labelled": _LABEL + r"[^\s\"']{6,}+",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}"
             r"|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|[2-9]\d{2} ?\d{3} ?\d{4})(?![\p{L}\p{N}])",
    "social": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\p{N}])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hex": r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{16,}+(?![\p{L}\p{N}])",
    "person": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {_NAME}(?: {_NAME})?",
}
#: Ending of a name that isn't part of it.
_GENITIVE = "['’][sS]?$"
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Cheap tests that every entity passes: a digit or mark, or the start of a key or a title.
MARKS = "[0-9@=:]"
STARTS = rf"(?=[ADFGHKLMPSgsΚГ])(?:AKIA|ASIA|gh[pousr]_|sk-|(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}})"
DIGIT_KINDS = ("phone", "social", "card")

# Replacement first names by script and gender, and syllables of family names.
FIRST = {
    "latin": {"m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Robin Simon Thomas Victor".split(),
              "f": "Alice Berta Clara Diana Emma Frida Greta Hanna Irene Julia Karin Laura Marta Nora Olivia Paula Rita Sofia Teresa Vera".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей Тимур".split(),
                 "f": "Алла Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья Тамара".split()},
    "greek": {"m": "Άρης Γιώργος Δημήτρης Κώστας Λεωνίδας Νίκος Πέτρος Σπύρος".split(), "f": "Άννα Βασιλική Ελένη Ζωή Κατερίνα Μαρία Σοφία Χαρά".split()},
}
SYLLABLES = {
    "latin": "bar ben dal dor fal fen gar gor hal hel jor kal ker lan lor mar mel nor pel ran rol sal ser tal tor val ven wal wen zor".split(),
    "cyrillic": "бар вел гор дан дор жар зор кал кор лан лев мар мел нор пет рад рос сав сел тар тор фед хол чер".split(),
    "greek": "βαρ γαλ δορ ζαν θεο καλ λαμ μαρ νικ παπ ραλ σαρ τζα φωτ χαρ ψαρ".split(),
}
ENDINGS = {"cyrillic": {"m": "ов", "f": "ова"}, "greek": {"m": "ίδης", "f": "ίδου"}, "latin": {"m": "", "f": ""}}
# Alphabets by character class.
CLASSES = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
           (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзийклмнопрстуфхцчшщъыьэюя"), (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
           (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
           (r"[\p{IsLatin}&&\p{Ll}]", "àáâäçèéêëíîïñóôöùúûü"), (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"),
           (r"[\p{IsHiragana}&&\p{Lo}]", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
           (r"[\p{IsKatakana}&&\p{Lo}]", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"))
# Categories of other scripts' letters and digits, told apart within a block of 128 characters.
OTHER = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl", "No")


def _byte(stream: Column, k: Column | int) -> Column:
    """k-th byte of a hash in 128 hex digits, from the start again beyond its end."""
    return F.conv(F.substring(stream, F.lit(k) % 64 * 2 + 1 if isinstance(k, int) else k % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _neighbour(c: Column, n: Column) -> Column:
    """Another letter or digit of the same category from the same 128 characters; a lone one gets a Latin letter."""
    base = F.floor(F.ascii(c) / 128).cast("int") * 128
    block = F.transform(F.sequence(base, base + 127), lambda k: F.when(k.between(0xD800, 0xDFFF), "").otherwise(F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "UTF-32")))
    of = lambda pattern: F.filter(block, lambda x: x.rlike(pattern) & (x != c))
    same = F
    for category in OTHER:
        same = same.when(c.rlike(rf"^\p{{{category}}}$"), of(rf"^\p{{{category}}}$"))
    return F.coalesce(F.get(same, n % F.greatest(F.size(same), F.lit(1))), _pick(CLASSES[1][1], n))


def _same_shape(value: Column, stream: Column, keep: Column, hexadecimal: bool = False) -> Column:
    """Characters of the same class each, from position ``keep`` on."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        out = F.when(i < keep, c)
        classes = (("[0-9]", "0123456789"), ("[a-f]", "abcdef"), ("[A-F]", "ABCDEF")) if hexadecimal else CLASSES
        for pattern, alphabet in classes:
            out = out.when(c.rlike(f"^{pattern}$"), _pick(alphabet, n))
        return out.when(c.rlike(r"^[\p{L}\p{N}]$"), _neighbour(c, n)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _word(words: list[str], n: Column) -> Column:
    return F.get(F.lit(words), (n % len(words)).cast("int"))


def _drawn(n: Column, one) -> Column:
    """``one(k)`` for k from 0 to n - 1, joined."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: one(k - 1)), "")).otherwise("")


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _replacement(kind: Column, value: Column, stream: Column) -> Column:
    """Replacement of a canonical value; person names come as kinds first_m, first_f, first_n, last_m, last_f, last_n."""
    draw = F.col("round")
    more = _drawn(draw - (SAME - 1), lambda k: (_byte(stream, 63 - k % 64) % 10).cast("string"))
    shape = F.concat(_same_shape(value, stream, F.when(kind == "phone", F.greatest(F.lit(0), F.char_length(value) - 10)).when(kind == "card", 1).when(kind == "key", 4).when(kind == "iban", 2).otherwise(0)), more)
    host = F.regexp_extract(value, r"^(.*)(\.[^.]+)$", 1)
    email = F.concat(_same_shape(host, stream, F.lit(0)), more, F.regexp_extract(value, r"^(.*)(\.[^.]+)$", 2))
    checked = F.get(F.filter(F.transform(F.lit([str(d) for d in range(10)]), lambda d: F.concat(F.substring(shape, F.lit(1), F.char_length(shape) - 1), d)), _luhn), 0)
    octet = lambda k: (_byte(stream, k) % 254 + 1).cast("string")
    private = F.regexp_extract(value, r"^(10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|127\.)", 1)
    rest = 4 - F.char_length(F.regexp_replace(private, r"[^.]", ""))
    public = F.concat_ws(".", (_byte(stream, 0) % 150 + 40).cast("string"), octet(1), octet(2), octet(3))
    public = F.when(public.rlike(r"^(?:127|172)\."), F.concat(F.lit("99."), F.concat_ws(".", octet(1), octet(2), octet(3)))).otherwise(public)
    groups = lambda n: F.regexp_replace(F.substring(stream, 33, 4 * n), "(.{4})(?=.)", "$1:")
    large = F.concat_ws(".", F.lit("10"), *[_byte(stream, k).cast("string") for k in range(3)])
    address = (F.when(draw >= 2 * SAME, F.concat(F.when(private == "", "2001:0db8:").otherwise("fd00:0000:"), groups(6))).when(private == "", public).when(draw >= SAME, large)
               .otherwise(F.concat(private, F.array_join(F.transform(F.sequence(F.lit(1), rest), lambda k: (_byte(stream, k) % 254 + 1).cast("string")), "."))))
    hexadecimal = _same_shape(value, stream, F.lit(0), True)
    first, last = F.lit(None).cast("string"), F.lit(None).cast("string")
    script, gender = _script(value), F.substring(kind, -1, 1)
    for s, names in FIRST.items():
        syllables = lambda n, at, s=s: _drawn(n, lambda k: _word(SYLLABLES[s], _byte(stream, k + at)))
        for g, words in (*names.items(), ("n", names["m"] + names["f"])):
            second = F.when(draw > 2, F.initcap(syllables(draw - 1, 1))).otherwise(_word(words, _byte(stream, 1)))
            first = F.when((script == s) & (gender == g), F.concat(_word(words, _byte(stream, 0)), F.when(draw > 0, F.concat(F.lit("-"), second)).otherwise(""))).otherwise(first)
            name = F.concat(syllables(3 + F.greatest(draw - 2, F.lit(0)), 0), F.lit(ENDINGS[s].get(g, ENDINGS[s]["m"])))
            last = F.when((script == s) & (gender == g), F.initcap(name)).otherwise(last)
    return (F.when(kind == "email", email).when(kind == "ip", address).when(kind == "ip6", F.when(draw >= SAME, groups(8)).otherwise(hexadecimal))
            .when((kind == "hex") | (kind == "labelled") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.concat(hexadecimal, more))
            .when((kind == "card") & _luhn(value), checked).when(kind.startswith("first_"), first).when(kind.startswith("last_"), last).otherwise(shape))


def has_entity(text: Column) -> Column:
    """Whether a text has an entity; most texts are told by the cheap tests."""
    return (text.rlike(MARKS) | text.rlike(STARTS)) & text.rlike(ANY)


def found(text: Column) -> Column:
    """Entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _kind(entity: Column) -> Column:
    out = F
    for kind, pattern in KINDS.items():
        out = out.when(entity.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("labelled")


def _gender(entity: Column) -> Column:
    title = F.regexp_extract(entity, r"^([^. ]+)", 1)
    return F.when(title.rlike(f"^(?:{MALE})$"), "m").when(title.rlike(f"^(?:{FEMALE})$"), "f").otherwise("n")


def _canonical(kind: Column, entity: Column) -> Column:
    return (F.when(kind.isin(*DIGIT_KINDS), F.regexp_replace(entity, r"[^0-9]", "")).when(kind == "iban", F.regexp_replace(entity, " ", ""))
            .when(kind == "email", F.lower(entity)).when(kind == "labelled", F.regexp_replace(entity, "^" + _LABEL, "")).otherwise(entity))


def _entries(kind: Column, entity: Column) -> Column:
    """(kind, value) of the dictionary entries that an occurrence needs: the last name first."""
    names = F.slice(F.split(F.regexp_replace(entity, _GENITIVE, ""), " "), 2, 2)
    last = F.struct(F.concat(F.lit("last_"), _gender(entity)).alias("kind"), F.lower(F.element_at(names, -1)).alias("value"))
    first = F.struct(F.concat(F.lit("first_"), _gender(entity)).alias("kind"), F.lower(F.get(names, 0)).alias("value"))
    one = F.array(F.struct(kind.alias("kind"), _canonical(kind, entity).alias("value")))
    return F.when(kind == "person", F.when(F.size(names) > 1, F.array(last, first)).otherwise(F.array(last))).otherwise(one)


def _formatted(kind: Column, entity: Column, new: Column) -> Column:
    """The occurrence with its replacements (``new``: of its entries, in order) in its own format."""
    value = F.get(new, 0)
    place = lambda i, kept: F.char_length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), kept, ""))
    filled = lambda test, kept: F.array_join(F.transform(F.split(entity, "(?!^)"), lambda c, i: F.when(c.rlike(test), F.substring(value, place(i, kept), F.lit(1))).otherwise(c)), "")
    label = F.regexp_extract(entity, "^(" + _LABEL + ")", 1)
    title = F.regexp_extract(entity, r"^([^ ]+ )", 1)
    name = F.regexp_replace(F.regexp_replace(entity, r"^[^ ]+ ", ""), _GENITIVE, "")
    upper = (F.upper(entity) == entity) & (F.lower(entity) != entity)
    beyond = lambda kept: F.substring(value, F.char_length(F.regexp_replace(entity, kept, "")) + 1, F.char_length(value))
    return (F.when(kind.isin(*DIGIT_KINDS), F.concat(filled("^[0-9]$", "[^0-9]"), beyond("[^0-9]"))).when(kind == "iban", F.concat(filled("^[A-Z0-9]$", " "), beyond(" ")))
            .when(kind == "labelled", F.concat(label, value)).when(kind == "email", F.when(upper, F.upper(value)).otherwise(value))
            .when(kind == "person", F.concat(title, _cased(name, F.concat(F.when(F.size(new) > 1, F.concat(F.get(new, 1), F.lit(" "))).otherwise(""), value)),
                                             F.regexp_extract(entity, f"({_GENITIVE})", 1))).otherwise(value))


def _cased(old: Column, new: Column) -> Column:
    """``new`` in capitals where ``old`` has more than one letter and all are capitals."""
    return F.when((F.upper(old) == old) & old.rlike(r"\p{Lu}.*\p{Lu}"), F.upper(new)).otherwise(new)


def _mentions(piece: Column, names: Column, pattern: Column) -> Column:
    """``piece`` with each match of ``pattern`` replaced by its entry in ``names`` (lower-cased name -> replacement)."""
    old, rest = F.regexp_extract_all(piece, pattern, F.lit(0)), F.split(piece, pattern, -1)
    return F.array_join(F.transform(rest, lambda s, i: F.concat(s, F.coalesce(_cased(F.get(old, i), F.element_at(names, F.lower(F.get(old, i)))), F.lit("")))), "")


def dictionary(entries: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, value, replacement) of the distinct (kind, value) rows of ``entries``, free of collisions.

    The namespace of a kind leaves out a trailing gender, so one family name never serves two.
    """
    space = F.regexp_replace("kind", "_[mfn]$", "")
    drawn = entries.select("kind", "value").distinct().withColumn("round", F.lit(0))
    for _ in range(64):
        stream = F.sha2(F.concat_ws("\n", F.lit(key), F.when(F.col("kind").startswith("last_"), "last").otherwise(F.col("kind")), F.col("value"), F.col("round").cast("string")).cast("binary"), 512)
        # few bytes but much work a row: not left to one task by the size of its partition
        drawn = drawn.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "value")
        made = saved(drawn.withColumn("space", space).withColumn("replacement", _replacement(F.col("kind"), F.col("value"), stream)), "pii-dictionary")
        taken = made.select(F.col("space").alias("s"), F.lower("value").alias("r")).distinct().withColumn("taken", F.lit(True))
        of = Window.partitionBy("space", "lowered").orderBy("round", "value", "kind")
        checked = made.withColumn("lowered", F.lower("replacement"))
        checked = checked.join(taken, (F.col("space") == F.col("s")) & (F.col("lowered") == F.col("r")), "left").drop("s", "r")
        owner = F.first("value").over(of)  # one value may stand for several genders
        bad = F.coalesce(F.col("taken"), F.lit(False)) | (owner != F.col("value"))
        checked = checked.withColumn("bad", bad & F.col("value").rlike(r"[\p{L}\p{N}]"))
        if not checked.where("bad").limit(1).count():
            return made.select("kind", "value", "replacement")
        drawn = checked.select("kind", "value", (F.col("round") + F.col("bad").cast("int")).alias("round"))
    raise ValueError("no distinct replacements left for some kind of entity")


def replace_entities(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in column ``text``; ``count``: a further column, the number of entities that ``KINDS`` match."""
    names = docs.columns
    plain = docs.where(F.col(text).isNull() | ~has_entity(F.col(text)))
    some = docs.where(has_entity(F.col(text))).select(*[F.col(c).alias(f"pii_{i}") for i, c in enumerate(names)], found(F.col(text)).alias("pii_found"))
    some = saved(some.withColumn("pii_row", F.monotonically_increasing_id()), "pii-texts")
    kind, entity = F.col("pii_kind"), F.col("pii_entity")
    parts = some.select("pii_row", F.posexplode("pii_found").alias("pii_at", "pii_entity")).withColumn("pii_kind", _kind(entity))
    parts = saved(parts.withColumn("pii_entries", _entries(kind, entity)), "pii-entities")
    flat = parts.select("pii_row", "pii_at", F.posexplode("pii_entries").alias("pii_k", "e")).select("pii_row", "pii_at", "pii_k", "e.kind", "e.value")
    made = dictionary(flat, key)
    # each text's own distinct entries first, so that repeated ones cross the shuffle once
    own = flat.select("pii_row", "kind", "value").distinct().join(made, ["kind", "value"])
    maps = own.groupBy("pii_row").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "value"), "replacement"))).alias("pii_map"))
    whole = some.join(maps, "pii_row")
    kinds, entries = lambda e: _kind(e), lambda e: _entries(_kind(e), e)
    new = lambda e: F.transform(entries(e), lambda x: F.element_at(F.col("pii_map"), x))
    surrogate = F.transform("pii_found", lambda e: _formatted(kinds(e), e, new(e)))
    between = F.split(F.col(f"pii_{names.index(text)}"), ANY, -1)
    # names that stand behind a title anywhere in the text are replaced where they stand alone, too
    entry = F.array_sort(F.filter(F.map_entries("pii_map"), lambda e: e["key"]["kind"].rlike("^(?:first|last)_")))
    told = F.transform(entry, lambda e: F.struct(e["key"]["value"].alias("name"), e["value"].alias("new")))
    known = F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?iu:"), F.array_join(F.map_keys("pii_names"), "|"), F.lit(r")(?!\p{L})"))
    whole = whole.withColumn("pii_between", between).withColumn("pii_told", told)
    # sorted by kind and name, so a name's first entry is the one after no equal name
    names_of = F.array_distinct(F.transform("pii_told", lambda e: e["name"]))
    whole = whole.withColumn("pii_names", F.map_from_arrays(names_of, F.transform(names_of, lambda n: F.element_at(F.filter("pii_told", lambda e: e["name"] == n), 1)["new"])))
    whole = whole.withColumn("pii_known", known)
    alone = F.when(F.size("pii_names") > 0, F.transform("pii_between", lambda s: _mentions(s, F.col("pii_names"), F.col("pii_known")))).otherwise(F.col("pii_between"))
    joined = F.array_join(F.transform(F.col("pii_between"), lambda s, i: F.concat(s, F.coalesce(F.get(F.col("pii_new"), i), F.lit("")))), "")
    whole = whole.withColumn("pii_between", alone).withColumn("pii_new", surrogate)
    extra = [F.size("pii_found").cast("long").alias(count)] if count else []
    done = whole.select(*[joined.alias(c) if c == text else F.col(f"pii_{i}").alias(c) for i, c in enumerate(names)], *extra)
    return plain.select(*names, *([F.lit(0).cast("long").alias(count)] if count else [])).unionByName(done)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, count="n_entities")
