"""Surrogates for personal data, in built-in functions only.

One regular expression finds entities; each distinct entity of the corpus gets a keyed surrogate of its kind, format,
script and, for names, gender. Numbers and addresses go through a keyed permutation of all values of their format, which
leaves none as it is, so that no two share a surrogate. Surrogates that are entities of the corpus themselves are drawn
again by another key, unless the corpus holds a quarter of the format's values or more: then a surrogate can be another
entity's value. A name's surrogate is put together from those of its parts: surnames are drawn as entities of their own,
once for all names that hold them, again until distinct, and given names are exchanged within their lists. Texts without
entities are neither shuffled nor changed."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import held, pick, saved, table

# Given names by gender and script.
NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carla Carmen Catherine Charlotte Claire Elena Elisabeth Emma Francesca Hannah Helena Isabel Jennifer Julia Katharina Laura Louise Lucia Maria Martha Mary Monika Nadia Nicole Olivia Patricia Rosa Sarah Sofia Susanne Teresa Ursula Victoria".split(),
    ("m", "latin"): "Adam Albert Alexander Andreas Anthony Carlos Charles Christian Daniel David Edward Felix Fernando Francis Frederick George Gustav Henry Jacques James John Joseph Klaus Lewis Manuel Martin Matthew Michael Nicolas Oliver Patrick Peter Philip Robert Stefan Thomas Victor William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Елена Ирина Лидия Людмила Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Александр Алексей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
# Forms of address, by gender ("n": either).
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Don Господин Κύριος".split(), "n": "Dr Prof".split()}
# Particles between given names and surnames, which stay.
PARTICLES = "van von der den de del della di da du dos la le ten ter zu zum zur af av bin ibn el al".split()
# Syllables of surnames by script.
SYLLABLES = {
    "latin": "ba be bor da del den du fal fen gar ger hal har hem kar kel ker lan lem lor mar mel mon nar nel nor pal pen ral ren ros sal sen sol tam tel tor val ver win".split(),
    "cyrillic": "ба бе бор да дел ду гар кар кел лан лем лор мар мел мон нор пал рен рос сал сен сол там тел тор вал вер зор".split(),
    "greek": "βα δα γαρ καλ κορ λαμ λεν μαρ μελ νορ παλ ρεν σαλ σολ ταμ τελ τορ φαν".split(),
}
# Alphabets within which a letter stays.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "安白成春德方光海和华建江金康林明南宁平青清山石天文小新星雪阳永玉元远月云"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(t for v in TITLES.values() for t in v)
_GIVEN = "|".join(n for v in NAMES.values() for n in v)
_PARTICLES = "|".join(PARTICLES)
_LETTERS = r"\p{L}\p{M}"
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: The kinds in order, with patterns that end where no entity of the kind goes on. Runs are possessive, so that the time
#: is in proportion to a text's length.
PATTERNS = {
    "ip": rf"(?<![.-])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}_-]|\.\d)",
    "ssn": r"(?<![.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<!\+)(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{3,4}(?:[ .-]?\d{2,4}){1,2}(?!\d)|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|\+\d{8,15}(?!\d)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}]|[.-]\d))",
    "card": rf"\d{{4}}(?:[ -]\d{{4}}){{3}}(?![\p{{L}}\p{{N}}_]|[ -]?\d)|\d{{13,19}}{_END}",
    "ip6": r"(?<!:)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "name": rf"(?:(?:(?:{_TITLE})\.? )(?:(?:{_GIVEN}) )*|(?:(?:{_GIVEN}) )+)(?:(?:{_PARTICLES}) )*\p{{Lu}}[{_LETTERS}]++(?:[-'’]\p{{Lu}}[{_LETTERS}]++)?",
    "email": r"(?<![.%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
}
_NUMBERS, _CAPITALS = ("ip", "ssn", "phone", "card"), ("iban", "name")
#: All of them after one look at what stands before, numbers' kinds only at a digit, + or (, names' only at a capital.
ENTITY = (
    _START + "(?:(?=[0-9+(])(?:" + "|".join(PATTERNS[k] for k in _NUMBERS) + ")|(?=[0-9A-Fa-f]{1,4}:)" + PATTERNS["ip6"]
    + r"|(?=\p{Lu})(?:" + "|".join(PATTERNS[k] for k in _CAPITALS) + ")|" + PATTERNS["email"] + ")"
)
#: Times that surrogates are drawn, at most; a surname is longer at every fourth.
ROUNDS = 30
#: Rounds of the permutation, and the share of a format's values from which the corpus fills it.
FEISTEL, FULL = 4, 0.25
#: What positions of a format hold: a character of an alphabet, of hexadecimal digits, or an octet of one, two or three
#: digits; and how many values each has.
HEX, OCTET = len(ALPHABETS), len(ALPHABETS) + 1
CHARACTERS = [*ALPHABETS, "0123456789abcdef"]
RADICES = [*map(len, CHARACTERS), 10, 90, 156]


def kind(raw: Column) -> Column:
    """The first kind whose pattern is all of an entity."""
    return F.coalesce(*[F.when(raw.rlike(rf"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("card"))


def norm(k: Column, raw: Column) -> Column:
    """What makes two mentions the same entity: digits for numbers, small letters else; a name without its title."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    bare = F.lower(F.regexp_replace(raw, rf"^(?:{_TITLE})\.? ", ""))
    return F.when(k.isin("ssn", "phone", "card"), digits).when(k == "iban", F.replace(raw, F.lit(" "))).when(k == "name", bare).otherwise(F.lower(raw))


def _byte(h: Column, i: Column) -> Column:
    """The i-th number, 0 to 255, of a hash of 128 hexadecimal digits (from its start again after 64)."""
    return F.conv(F.substring(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _cases(of: Column, values: list) -> Column:
    """The value at a number, of a list."""
    return F.element_at(F.array(*map(F.lit, values)), of + 1)


def _free(k: Column, n: Column) -> Column:
    """The part of an entity's normal form whose characters are exchanged: a mail address but for its top domain, a card's
    digits but the last, an account but for its country and check digits."""
    return (
        F.when(k == "email", F.regexp_extract(n, r"^(.*)\.", 1)).when(k == "card", F.substring(n, F.lit(1), F.length(n) - 1))
        .when(k == "iban", F.lower(F.substring(n, F.lit(5), F.length(n)))).otherwise(n)
    )


def _pieces(k: Column, n: Column) -> Column:
    return F.when(k == "ip", F.split(n, r"\.")).otherwise(F.split(_free(k, n), ""))


def _holds(k: Column, n: Column, pieces: Column) -> Column:
    """What each piece holds, as a place in RADICES, or -1 where it stays: signs, a card's first digit and a phone number's
    leading ones. A letter of no alphabet is as if it were a Latin one."""
    keep = F.when(k == "card", 1).when((k == "phone") & (F.length(n) > 10), F.length(n) - 10).otherwise(0)
    character = lambda c: F.coalesce(*[F.when(F.instr(F.lit(a), c) > 0, i) for i, a in enumerate(ALPHABETS)], F.when(c.rlike(r"^\p{L}$"), 1), F.lit(-1))
    held = lambda c, i: F.when(k == "ip", F.length(c) + (OCTET - 1)).when(i < keep, -1).when((k == "ip6") & (c != ":"), HEX).otherwise(character(c))
    return F.transform(pieces, held)


def _numbers(pieces: Column, holds: Column) -> Column:
    """Each piece's number among the values of what it holds."""
    place = lambda c, h: F.coalesce(*[F.when(h == i, F.instr(F.lit(a), c) - 1) for i, a in enumerate(CHARACTERS)])
    one = lambda c, h: F.when(h < 0, 0).when(h >= OCTET, c.try_cast("int") - _cases(h - OCTET, [0, 10, 100])).otherwise(F.when(F.instr(_cases(h, CHARACTERS), c) > 0, place(c, h)).otherwise(F.pmod(F.ascii(c), F.lit(26))))
    return F.zip_with(pieces, holds, one)


def _permuted(v: Column, radices: Column, key: str, tweak: Column) -> Column:
    """Numbers of the same radices, by a bijection without a fixed point: a Feistel network over the numbers at even and
    at odd places, one step up of the first number that can change, and the network's inverse."""

    def rounds(v: Column, order: list[int], sign: int) -> Column:
        def one(acc: Column, r: Column) -> Column:
            other = F.array_join(F.transform(F.filter(acc, lambda x, i: i % 2 != r % 2), lambda x: x.cast("string")), ",")
            h = F.sha2(F.concat_ws("\0", F.lit(key), tweak, r.cast("string"), other), 512)
            add = lambda i: sign * (_byte(h, i * 2) * 256 + _byte(h, i * 2 + 1))
            return F.transform(acc, lambda x, i: F.when(i % 2 == r % 2, F.pmod(x + add(i), F.element_at(radices, i + 1))).otherwise(x))

        return F.aggregate(F.array(*map(F.lit, order)), v, one)

    first = F.array_position(F.transform(radices, lambda r: (r > 1).cast("int")), 1)
    up = lambda w: F.transform(w, lambda x, i: F.when(i + 1 == first, F.pmod(x + 1, F.element_at(radices, i + 1))).otherwise(x))
    order = list(range(FEISTEL))
    return rounds(up(rounds(v, order, 1)), order[::-1], -1)


def _luhn(digits: Column) -> Column:
    """The sum, by ten, that is 0 for a valid card number."""
    turned = F.split(F.reverse(digits), "")
    add = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(add, F.lit(0), lambda a, x: a + x), F.lit(10))


def _mod97(s: Column) -> Column:
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _account(s: Column) -> Column:
    """An account's right check digits, as a number."""
    return 98 - _mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 2), F.lit("00")))


def _put(k: Column, n: Column, pieces: Column, holds: Column, v: Column) -> Column:
    """The normal form with other numbers in its pieces. What checks a number is off by as much as before: by nothing, if
    it was right."""
    text = lambda h, x: F.when(h >= OCTET, (x + _cases(h - OCTET, [0, 10, 100])).cast("string")).otherwise(F.substring(_cases(F.least(h, F.lit(HEX)), CHARACTERS), x + 1, F.lit(1)))
    new = F.zip_with(F.zip_with(holds, v, lambda h, x: F.when(h >= 0, text(h, x))), pieces, lambda t, c: F.coalesce(t, c))
    body = F.array_join(new, "")
    last = F.substring(n, F.length(n), F.lit(1)).try_cast("int")
    checked = lambda b: F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10))
    card = F.concat(body, F.pmod(checked(body) + last - checked(_free(k, n)), F.lit(10)).cast("string"))
    raised = F.concat(F.substring(n, 1, 4), F.upper(body))
    off = F.substring(n, F.lit(3), F.lit(2)).try_cast("int") - _account(n)
    iban = F.concat(F.substring(n, 1, 2), F.lpad(F.pmod(_account(raised) + off, F.lit(100)).cast("string"), 2, "0"), F.upper(body))
    return F.when(k == "ip", F.array_join(new, ".")).when(k == "card", card).when(k == "iban", iban).when(k == "email", F.concat(body, F.lit("."), F.regexp_extract(n, r"\.([^.]*)$", 1))).otherwise(body)


def script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(x.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def given_names(key: str) -> dict[str, str]:
    """Another listed given name of the gender and script for each, no two the same: lists in the order of keyed hashes,
    each name by the next one."""
    out = {}
    for names in NAMES.values():
        order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}\0given\0{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def _capitalised(s: Column) -> Column:
    """A name's parts with a capital, but for particles."""
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.when(w.isin(PARTICLES), w).otherwise(F.initcap(w))), " ")


def _surname(s: Column, h: Column, syllables: dict[str, Column]) -> Column:
    """Syllables of the script, as many as there are numbers in `syllables` for it."""
    pick_of = lambda words, i: F.element_at(F.array(*map(F.lit, words)), F.pmod(_byte(h, i * 2) * 256 + _byte(h, i * 2 + 1), F.lit(len(words))) + 1)
    made = lambda z, words: F.array_join(F.transform(F.sequence(F.lit(0), syllables[z] - 1), lambda i: pick_of(words, i)), "")
    return F.coalesce(*[F.when(script(s) == z, made(z, words)) for z, words in SYLLABLES.items()])


def dressed(k: Column, raw: Column, s: Column) -> Column:
    """A surrogate's normal form in the format of a mention: its signs and spaces, capitals and title."""
    chars = F.split(raw, "")
    count = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), r"[^0-9]", ""))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(s, count(i), F.lit(1))).otherwise(c)), "")
    spaced = lambda i: F.length(F.replace(F.substring(raw, F.lit(1), i + 1), F.lit(" ")))
    iban = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(s, spaced(i), F.lit(1)))), "")
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\p{Lu}$"), F.upper(F.substring(s, i + 1, F.lit(1)))).otherwise(F.substring(s, i + 1, F.lit(1)))), "")
    title = F.regexp_extract(raw, rf"^(?:(?:{_TITLE})\.? )?", 0)
    return F.when(k.isin("phone", "card", "ssn"), digits).when(k == "iban", iban).when(k == "name", F.concat(title, _capitalised(s))).when(F.length(s) == F.length(raw), cased).otherwise(s)


def surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind and norm of distinct entities, with the surrogate's normal form `to`, distinct within the kind and not the
    entity itself."""
    given = given_names(key) | {p: p for p in PARTICLES}
    names = entities.filter(F.col("kind") == "name").select("norm", F.posexplode(F.split("norm", " ")).alias("place", "part"), F.size(F.split("norm", " ")).alias("n"))
    # a listed given name is one only before another part
    names = saved(names.withColumn("given", (F.col("place") < F.col("n") - 1) & F.col("part").isin(*given)))
    surnames = names.filter(~F.col("given")).select(F.lit("surname").alias("kind"), F.col("part").alias("norm")).distinct()
    to = saved(_permutations(entities.filter(F.col("kind") != "name"), key, rounds).unionByName(_surnames(surnames, key, rounds)))
    same = names.join(to.filter(F.col("kind") == "surname").select(F.col("norm").alias("part"), "to"), "part", "left")
    other = F.element_at(F.create_map(*[F.lit(x) for pair in given.items() for x in pair]), F.col("part"))
    same = same.groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("given"), other).otherwise(F.col("to")).alias("to")))).alias("x"))
    return to.filter(F.col("kind") != "surname").unionByName(same.select(F.lit("name").alias("kind"), "norm", F.array_join(F.col("x.to"), " ").alias("to")))


def _permutations(entities: DataFrame, key: str, rounds: int) -> DataFrame:
    """kind, norm and `to` of numbers and addresses. Of a format that isn't full, those that became an entity of the corpus
    or met another surrogate go through the permutation of the next attempt's key; a format with such ones after the last
    attempt counts as full. In a full one all have the first attempt's surrogates."""
    k, n = F.col("kind"), F.col("norm")
    parts = entities.withColumn("pieces", _pieces(k, n)).withColumn("holds", _holds(k, n, F.col("pieces")))
    parts = parts.withColumn("format", F.concat_ws("\0", k, F.array_join(F.zip_with("holds", "pieces", lambda h, c: F.when(h < 0, c).otherwise(h.cast("string"))), "|"), F.when(k == "email", F.regexp_extract(n, r"\.([^.]*)$", 1)), F.when(k == "iban", F.substring(n, 1, 2))))
    parts = parts.withColumns({"v": _numbers(F.col("pieces"), F.col("holds")), "radices": F.transform("holds", lambda h: F.when(h < 0, 1).otherwise(_cases(F.greatest(h, F.lit(0)), RADICES)))})
    values = F.aggregate("radices", F.lit(0.0), lambda a, r: a + F.ln(r.cast("double")))
    sizes = parts.groupBy("format").agg(F.count("*").alias("n"), F.max(values).alias("log")).select("format", (F.ln(F.col("n").cast("double")) >= F.col("log") + math.log(FULL)).alias("full"))
    now = saved(parts.join(sizes, "format").withColumn("attempt", F.lit(0)))
    real = entities.select("kind", n.alias("to")).withColumn("taken", F.lit(True))
    to = _put(k, n, F.col("pieces"), F.col("holds"), _permuted(F.col("v"), F.col("radices"), key, F.concat_ws("\0", "format", F.col("attempt").cast("string"))))
    for r in range(rounds + 1):
        drawn = now.withColumn("to", to)
        first = F.row_number().over(Window.partitionBy("kind", "to").orderBy("attempt", "norm"))
        drawn = drawn.withColumn("place", first).join(real, ["kind", "to"], "left")
        # letters of no alphabet make a permutation of less than all values, so that two can meet in a full format, too
        again = F.when(F.col("full"), F.col("place") > 1).otherwise((F.col("place") > 1) | F.coalesce("taken", F.lit(False)))
        drawn = saved(drawn.withColumn("again", again).drop("place", "taken"))
        if r == rounds or not drawn.filter("again").limit(1).count():
            return drawn.select("kind", "norm", "to")
        now = drawn.withColumn("attempt", F.col("attempt") + F.col("again").cast("int")).drop("to", "again")
        if r == rounds - 1:
            ends = drawn.groupBy("format").agg(F.max("again").alias("ends"))
            now = now.join(ends, "format").withColumns({"full": F.col("full") | F.col("ends"), "attempt": F.when(F.col("ends"), 0).otherwise(F.col("attempt"))}).drop("ends")
    raise AssertionError


def _surnames(entities: DataFrame, key: str, rounds: int) -> DataFrame:
    """kind, norm and `to` of surnames. They have three syllables, and more where there are many of them, so that at most
    one in eight draws of a script meets another; each fourth attempt is longer. Of those that meet, the one that comes
    first by attempt and letters keeps its draw."""
    k, n = F.col("kind"), F.col("norm")
    entities = saved(entities)
    numbers = {r.z: r.n for r in entities.groupBy(script(n).alias("z")).agg(F.count("*").alias("n")).collect()}
    syllables = {z: max(3, math.ceil(math.log(8 * numbers.get(z, 1)) / math.log(len(words)))) for z, words in SYLLABLES.items()}
    longer = {z: F.lit(x) + F.floor(F.col("attempt") / 4).cast("int") for z, x in syllables.items()}
    real = entities.select(n.alias("to")).withColumn("taken", F.lit(True))
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        drawn = now.withColumn("to", _surname(n, F.sha2(F.concat_ws("\0", F.lit(key), k, n, F.col("attempt").cast("string")), 512), longer))
        first = F.row_number().over(Window.partitionBy("to").orderBy("attempt", "norm"))
        drawn = drawn.withColumn("place", first).join(real, "to", "left")
        drawn = saved(drawn.withColumn("again", (F.col("place") > 1) | F.coalesce("taken", F.lit(False))))
        if not drawn.filter("again").limit(1).count():
            break
        now = drawn.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    else:
        raise RuntimeError(f"Surnames still meet after {rounds} draws")
    return drawn.select("kind", "norm", "to")


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str) -> DataFrame:
    """docs with its columns called _0, _1 and so on, each entity of `text` replaced by its surrogate, and n_entities.

    Texts without entities, null and empty ones too, stay as they are, with 0. The same key gives the same surrogates
    for the same corpus. Equal texts get equal results, however often they come; no rows give no rows. Texts are read
    whole. Columns other than text don't matter and stay."""
    out, t = held(docs), F.col(f"_{docs.columns.index(text)}")
    name = f"_{docs.columns.index(text)}"
    has = F.coalesce(t.rlike(ENTITY), F.lit(False))
    clean = out.filter(~has).withColumn("n_entities", F.lit(0).cast("long"))
    dirty = out.filter(has).withColumn("__text", F.md5(t.cast("binary")))
    raw = dirty.select("__text", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)))).alias("raw")).distinct()
    raw = raw.withColumn("kind", kind(F.col("raw"))).withColumn("norm", norm(F.col("kind"), F.col("raw")))
    mentions = saved(raw)
    entities = mentions.select("kind", "norm").distinct()
    to = surrogates(saved(entities), key)
    by_text = mentions.join(to, ["kind", "norm"]).select("__text", F.struct("raw", dressed(F.col("kind"), F.col("raw"), F.col("to"))).alias("e")).groupBy("__text").agg(F.map_from_entries(F.collect_list("e")).alias("__map"))
    found = F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))
    new = F.array_join(F.zip_with(F.split(t, ENTITY, -1), F.transform(found, lambda e: F.element_at(F.col("__map"), e)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    replaced = dirty.join(by_text, "__text").withColumn("n_entities", F.size(found).cast("long")).withColumn(name, new)
    return clean.unionByName(replaced.select(*clean.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return pseudonymise(docs, key="surrogates-1").select(F.col("_0").alias("doc_id"), "n_entities", F.col("_1").alias("text"))
