"""Personal data replaced by keyed surrogates of the same type, script, gender and format; DataFrame functions only.

Entities are found by one regular expression. A surrogate is a keyed permutation of the entity's own characters: a
Feistel network whose rounds shift each character within its class (digits stay digits, upper case stays upper case, Greek stays
Greek, vowels of a name stay vowels) by a keyed hash of the other half. It is the same wherever the entity occurs, and
two entities of one form never share one. What a permutation cannot promise (a surrogate that equals its original or
some other person's data, or that meets another form's surrogate) is checked over all distinct entities, and only those
that fail are drawn again. Each draw of a name has more given names to choose from; entities that a permutation cannot hide (masks,
scripts without an alphabet here) or whose form is nearly full get a surrogate from a keyed hash, in a wider alphabet or with
digits added, from a space that grows until all have one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

# Titles, given names by gender and script, alphabets.
TITLES = {
    "male": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "κύριος"),
    "female": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "κυρία"),
    "any": ("Dr", "Prof"),
}
GIVEN = {
    ("male", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Noah", "Oscar", "Paul"),
    ("female", "latin"): ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("male", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"),
    ("female", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("male", "greek"): ("Ανδρέας", "Γιώργος", "Νίκος", "Πέτρος"),
    ("female", "greek"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
}
DIGITS, HEX_LOWER, HEX_UPPER = "0123456789", "abcdef", "ABCDEF"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHER = (
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "άέήίόύώ",
)
SPOKEN = ("aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", *OTHER[:2], *OTHER[4:])

_title = "|".join(sorted({t for ts in TITLES.values() for t in ts}, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Most spaces on either side of a secret's = or : (Java wants look-behinds to be bounded). A quoted value goes up to its closing quote.
GAP = 32
_SECRET_AFTER = rf"(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey)(?:\\?[\"'])?\h{{0,{GAP}}}[=:]{{1,2}}>?\h{{0,{GAP}}}\\?"
#: In order of precedence: type and regular expression (Java).
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})*\.\p{L}{2,24}"),
    ("secret", rf"(?<=[=:>\h\"'])(?<=[=:]>?\h{{0,{GAP}}}\\?[\"']?)(?:{_SECRET_AFTER}\")[^\"\r\n]{{4,}}(?=\")|{_SECRET_AFTER}')[^'\r\n]{{4,}}(?=')|{_SECRET_AFTER}[\"']?)[^\s,;\"']{{4,}})"),
    ("access_key", r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\p{L}\p{N}])"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("card", r"(?<![\d+])(?:[2-6]\d{12,18}|[2-6]\d{3}(?:[ -]\d{4}){2}[ -]\d{1,7}|3\d{3}[ -]\d{6}[ -]\d{5})(?!\d)"),
    ("national_id", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}|\d{3}([ .-])\d{3}\1\d{4})(?!\d)"),
    ("name", rf"(?<!\p{{L}})(?:{_title})\.? \p{{Lu}}[\p{{L}}'’-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'’-]{{1,40}})?"),
)
#: What a text must contain for a match of each type: any of these strings or, for the numbers, this cheap expression.
_NUMBER = r"\d[\d .()-]{3,}\d"
_NEEDED = {
    "email": ("@",), "secret": ("passw", "pwd", "secret", "token", "api_key", "apikey"), "access_key": ("AKIA", "ASIA"), "iban": r"[A-Z]{2}\d{2}",
    "ip": _NUMBER, "card": _NUMBER, "national_id": _NUMBER, "phone": _NUMBER, "name": tuple(t for t in sorted({t for ts in TITLES.values() for t in ts}) if not any(t != u and t.startswith(u) for us in TITLES.values() for u in us)),
}
ROUNDS = 4
#: Redrawn entities up to which their draws are put into the plan as literals; beyond, they are joined.
INLINE_REDRAWS = 1000
#: Draws from which on a surrogate is made freely, and after how many more addresses get their longer form.
FREE_DRAW, LONG_DRAWS = 4, 4
#: Kinds whose whole text a free surrogate replaces; the others get digits added to them.
_FREE = ("email", "ip", "name", "secret")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. The inner function has one parameter: a second one would be bound to an index."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _chars(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.lit(1))))


def _shift_char(c: Column, by: Column, alphabets: Column) -> Column:
    """c moved on in the first alphabet that has it; other characters stay."""
    own = F.try_element_at(F.filter(alphabets, lambda a: F.instr(a, c) > 0), F.lit(1))
    return let(own, lambda a: F.when(a.isNull(), c).otherwise(F.substring(a, (F.pmod(F.instr(a, c) - 1 + by, F.length(a)) + 1).cast("int"), F.lit(1))))


def _shifted(half: Column, other: Column, seed: Column, round_: int, alphabets: Column) -> Column:
    """half with each character moved by a keyed hash of the other half, whatever its case; the hash is used in turn."""
    stream = F.sha2(F.concat(F.lit(f"{round_}|"), seed, F.lit("|"), F.lower(other)), 512)
    move = lambda h, i: F.conv(F.substring(h, (F.pmod(i, F.lit(32)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long") + i
    return let(stream, lambda h: F.array_join(F.transform(_chars(half), lambda c, i: _shift_char(c, move(h, i), alphabets)), ""))


def permuted(s: Column, seed: Column, alphabets: Column) -> Column:
    """A keyed permutation of the strings with the same classes of characters at the same places."""
    pair = let(s, lambda x: F.struct(F.substring(x, F.lit(1), (F.length(x) / 2).cast("int")).alias("a"), F.substring(x, (F.length(x) / 2).cast("int") + 1, F.length(x)).alias("b")))
    for k in range(ROUNDS):
        if k % 2:
            pair = let(pair, lambda p, k=k: F.struct(_shifted(p["a"], p["b"], seed, k, alphabets).alias("a"), p["b"].alias("b")))
        else:
            pair = let(pair, lambda p, k=k: F.struct(p["a"].alias("a"), _shifted(p["b"], p["a"], seed, k, alphabets).alias("b")))
    return let(pair, lambda p: F.concat(p["a"], p["b"]))


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _bare(e: Column) -> Column:
    return F.regexp_replace(e, " ", "")


def _pour(e: Column, filling: Column, holes: str) -> Column:
    """e with the characters that match ``holes`` replaced by those of ``filling`` in turn."""
    at = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), (i + 1).cast("int")), f"[^{holes}]", ""))
    return let(filling, lambda f: F.array_join(F.transform(_chars(e), lambda c, i: F.when(c.rlike(f"[{holes}]"), F.substring(f, at(i), F.lit(1))).otherwise(c)), ""))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a number that still lacks its last digit, modulo 10."""
    n = F.length(digits)
    value = lambda c, i: let(c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.pmod(F.aggregate(F.transform(_chars(digits), value), F.lit(0), lambda a, b: a + b.cast("int")), F.lit(10))


def _check_digits(country_last: Column) -> Column:
    """IBAN check digits of account + country + 00."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.lpad((98 - F.aggregate(_chars(F.concat(country_last, F.lit("00"))), F.lit(0), step)).cast("string"), 2, "0")


def _given(e: Column, title: Column, seed: Column) -> Column:
    """A given name of the title's gender and the name's script; the gender of titles for either is drawn. Later draws have two and
    then three names."""
    bare, draw = F.regexp_replace(title, r"\.$", ""), F.element_at(F.split(seed, r"\|"), -1).cast("int")
    script = F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").when(e.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def choose(pick: Column) -> Column:
        gender = F.when(bare.isin(*TITLES["male"]), "male").when(bare.isin(*TITLES["female"]), "female").when(F.pmod(pick, F.lit(2)) == 1, "male").otherwise("female")
        names = F.create_map(*[x for (g, s), n in GIVEN.items() for x in (F.lit(f"{g} {s}"), F.array(*map(F.lit, n)))])
        one = lambda n, k: F.element_at(n, (F.pmod(F.floor(pick / (2 * 16**k)), F.size(n).cast("long")) + 1).cast("int"))
        return let(F.element_at(names, F.concat_ws(" ", gender, script)), lambda n: F.concat_ws("-", one(n, 0), F.when(draw > 0, one(n, 1)), F.when(draw > 1, one(n, 2))))

    return let(F.conv(F.substring(F.sha2(F.concat(F.lit("given|"), seed, F.lit("|"), F.lower(e)), 256), F.lit(1), F.lit(7)), 16, 10).cast("long"), choose)


_TAIL, _TITLE = r"\.\p{L}+$", rf"^(?:{_title})\.?"
_NUMBERS = ("card", "phone", "national_id")


def _movable(kind: Column, e: Column) -> Column:
    """The characters of an entity that its surrogate changes, in one string."""
    digits, octets = _digits(e), F.split(e, r"\.")
    return (
        F.when(kind == "card", F.substring(digits, F.lit(2), F.length(digits) - 2))
        .when(kind.isin("phone", "national_id"), F.right(digits, F.lit(10)))
        .when(kind == "email", F.regexp_replace(e, _TAIL, ""))
        .when(kind == "ip", F.lower(F.lpad(F.hex(octets[1].try_cast("long") * 65536 + octets[2].try_cast("long") * 256 + octets[3].try_cast("long")), 6, "0")))
        .when(kind.isin("access_key", "iban"), F.substring(_bare(e), F.lit(5), F.length(e)))
        .when(kind == "name", F.element_at(F.split(e, " "), -1))
        .otherwise(e)
    )


def _alphabets(kind: Column, e: Column) -> Column:
    letters = lambda names: F.array(*map(F.lit, names))
    is_hex = (kind == "secret") & e.rlike("^[0-9a-f]+$|^[0-9A-F]+$")
    return F.when(kind.isin(*_NUMBERS), letters([DIGITS])).when(kind == "ip", letters([DIGITS + HEX_LOWER])).when(is_hex, letters([DIGITS, HEX_LOWER, HEX_UPPER])).when(kind == "name", letters(SPOKEN)).otherwise(letters([DIGITS, LOWER, UPPER, *OTHER]))


def _assembled(kind: Column, e: Column, p: Column, seed: Column) -> Column:
    """The surrogate around the permuted characters p.

    Cards keep their first digit and stay valid or invalid; phones keep what stands before the last ten digits; IPs the first octet;
    IBANs the country, with new check digits; e-mail the last domain label; names the title, which gives the gender.
    """
    digits, bare = _digits(e), _bare(e)
    old, head = F.substring(digits, F.lit(1), F.length(digits) - 1), F.concat(F.substring(digits, F.lit(1), F.lit(1)), p)
    card = F.concat(head, F.pmod(F.right(digits, F.lit(1)).try_cast("int") + _luhn(old) - _luhn(head), F.lit(10)).cast("string"))
    phone = F.concat(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0))), p)
    octet = lambda i: F.conv(F.substring(p, F.lit(i), F.lit(2)), 16, 10)
    country, title = F.substring(bare, F.lit(1), F.lit(2)), F.regexp_extract(e, _TITLE, 0)
    return (
        F.when(kind.isin(*_NUMBERS), _pour(e, F.when(kind == "card", card).when(kind == "phone", phone).otherwise(p), "0-9"))
        .when(kind == "email", F.concat(p, F.regexp_extract(e, _TAIL, 0)))
        .when(kind == "ip", F.concat_ws(".", F.split(e, r"\.")[0], octet(1), octet(3), octet(5)))
        .when(kind == "access_key", F.concat(F.substring(e, F.lit(1), F.lit(4)), p))
        .when(kind == "iban", _pour(e, F.concat(country, _check_digits(F.concat(p, country)), p), "0-9A-Z"))
        .when(kind == "name", F.concat_ws(" ", title, F.when(F.size(F.split(F.regexp_replace(e, _TITLE, ""), " ")) > 2, _given(e, title, seed)), p))
        .otherwise(p)
    )


def entity_type(e: Column) -> Column:
    """The first type whose whole expression an entity matches; what stands before it was checked when it was found."""
    out = None
    for name, pattern in PATTERNS:
        if name == "secret":
            continue
        bare = pattern.replace(r"(?<![\p{L}\p{N}._%+-])", "").replace(r"(?<![\p{L}\p{N}])", "").replace(r"(?<![\d.])", "").replace(r"(?<![\d+])", "").replace(r"(?<![\d-])", "").replace(r"(?<!\p{L})", "")
        test = e.rlike(f"^(?:{bare})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("secret")


def canonical(kind: Column, e: Column) -> Column:
    """What makes two mentions one entity: digits for cards and ids, the last ten for phones, no case for e-mail and names."""
    return let(e, lambda x: F.when(kind.isin("card", "national_id"), _digits(x)).when(kind == "phone", F.right(_digits(x), F.lit(10))).when(kind == "iban", _bare(x)).when(kind.isin("email", "name"), F.lower(x)).otherwise(x))


def _stuck(kind: Column, movable: Column) -> Column:
    """Whether a permutation leaves all characters, or most letters and digits, as they are. Case makes no difference."""
    count = lambda m, chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
    own = lambda m: F.when(kind == "name", count(m, "".join(SPOKEN).lower())).otherwise(count(m, "".join([DIGITS, LOWER, *OTHER]).lower()))
    few = lambda m: let(own(m), lambda n: (n == 0) | (2 * n < count(m, r"\p{L}\p{N}")))
    return F.when(kind.isin("email", "name", "secret"), let(F.lower(movable), few)).otherwise(False)


def _free(kind: Column, e: Column, seed: Column, draw: Column) -> Column:
    """A surrogate of a kind of _FREE from a keyed hash; names and e-mail in the entity's script where it has an alphabet here."""
    title = F.regexp_extract(e, _TITLE, 0)
    letters = F.when(e.rlike(r"\p{IsCyrillic}"), "абвгдежзиклмнопр").when(e.rlike(r"\p{IsGreek}"), "αβγδεζηθικλμνξοπ").otherwise("abcdefghiklmnopr")

    def made(h: Column) -> Column:
        spelled = let(letters, lambda a: F.array_join(F.transform(_chars(F.substring(h, F.lit(1), F.lit(24))), lambda c: F.substring(a, F.conv(c, 16, 10).cast("int") + 1, F.lit(1))), ""))
        octet = lambda i: F.conv(F.substring(h, F.lit(i), F.lit(2)), 16, 10)
        return (
            F.when(kind == "email", let(spelled, lambda w: F.concat(F.substring(w, F.lit(1), F.lit(12)), F.lit("@"), F.substring(w, F.lit(13), F.lit(12)), F.regexp_extract(e, _TAIL, 0))))
            .when((kind == "ip") & (draw >= FREE_DRAW + LONG_DRAWS), F.concat(F.lit("fd"), F.substring(h, F.lit(1), F.lit(2)), *[F.concat(F.lit(":"), F.substring(h, F.lit(i), F.lit(4))) for i in range(3, 31, 4)]))
            .when(kind == "ip", F.concat_ws(".", octet(1), octet(3), octet(5), octet(7)))
            .when(kind == "name", F.concat_ws(" ", title, F.when(F.size(F.split(F.regexp_replace(e, _TITLE, ""), " ")) > 2, _given(e, title, seed)), F.initcap(F.substring(spelled, F.lit(1), F.lit(12)))))
            .otherwise(F.substring(h, F.lit(1), F.lit(24)))
        )

    return let(F.sha2(F.concat(F.lit("free|"), seed, F.lit("|"), canonical(kind, e)), 256), made)


def _added(kind: Column, e: Column, seed: Column, draw: Column) -> Column:
    """Four digits or more, so that a number has ten at least; one more with each draw."""
    h = F.sha2(F.concat(F.lit("added|"), seed, F.lit("|"), canonical(kind, e)), 256)
    digits = F.array_join(F.transform(_chars(F.substring(h, F.lit(1), F.lit(60))), lambda c: F.pmod(F.conv(c, 16, 10).cast("int"), F.lit(10)).cast("string")), "")
    return F.substring(digits, F.lit(1), F.greatest(10 - F.length(_digits(e)), F.lit(4)) + draw - FREE_DRAW)


def surrogate(kind: Column, e: Column, key: str, draw: Column) -> Column:
    free = kind.isin(*_FREE)

    def made(seed: Column) -> Column:
        more = F.when((draw >= FREE_DRAW) & ~free, _added(kind, e, seed, draw)).otherwise("")
        moved = lambda m: let(permuted(m, seed, _alphabets(kind, e)), lambda p: F.concat(_assembled(kind, e, p, seed), more))
        return let(_movable(kind, e), lambda m: F.when(((draw >= FREE_DRAW) & free) | _stuck(kind, m), _free(kind, e, seed, draw)).otherwise(moved(m)))

    return let(F.concat(F.lit(f"{key}|"), kind, F.lit("|"), draw.cast("string")), made)


def _finder(text: Column, number: Column) -> Column:
    """The expression for the types that a text can hold, in order of precedence; empty if it can hold none. ``number`` tells whether it has
    a match of _NUMBER."""

    def holds(t: Column, strings: tuple) -> Column:
        out = F.lit(False)
        for x in strings:
            out = out | t.contains(x)
        return out

    def able(kind: str) -> Column:
        need = _NEEDED[kind]
        if kind == "secret":
            return F.when(holds(text, ("=", ":")), holds(F.lower(text), need)).otherwise(False)
        return (number & text.contains(".") if kind == "ip" else number) if need == _NUMBER else text.rlike(need) if isinstance(need, str) else holds(text, need)

    return F.concat_ws("|", *[F.when(able(name), F.lit(f"(?:{pattern})")) for name, pattern in PATTERNS])


def parted(docs: DataFrame) -> DataFrame:
    """docs with ``__parts``: the texts with entities cut into gap, entity, gap, ..., gap; null for the others. One pass of the expression
    marks the entities with a string that the text does not hold."""
    text = F.col("text")
    mark = F.when(text.contains("\x00"), F.concat(F.lit("\x00"), F.md5(text.cast("binary")), F.lit("\x00"))).otherwise(F.lit("\x00"))
    marked = docs.withColumn("__number", text.rlike(_NUMBER)).withColumns({"__finder": _finder(text, F.col("__number")), "__mark": mark})
    cut = F.split(F.regexp_replace(text, F.col("__finder"), F.concat("__mark", F.lit("$0"), "__mark")), F.col("__mark"), -1)
    parts = marked.withColumn("__parts", F.when(F.col("__finder") != "", cut)).drop("__number", "__finder", "__mark")
    return parts.withColumn("__parts", F.when(F.size("__parts") > 1, F.col("__parts")))


def _odd(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: F.pmod(i, F.lit(2)) == 1)


def redraws(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canon, draw) of the entities whose surrogate had to be drawn again.

    ``entities`` has one row (kind, canon, entity) an entity. A surrogate that equals an original of its kind or a settled
    surrogate is bad; of those that share one in a round, the least by hash keeps it. Only bad ones get the next draw. From FREE_DRAW on
    draws have so much space, and more with each draw, that the rounds end whatever the entities are.
    """
    pending, settled, k = entities.withColumn("draw", F.lit(0)), [], 0
    while True:
        made = pending.withColumn("made", canonical(F.col("kind"), surrogate(F.col("kind"), F.col("entity"), key, F.col("draw"))))
        made = scratch.write(made, f"round-{k}")
        taken = entities.select("kind", F.col("canon").alias("made"))
        for rows in settled:
            taken = taken.union(rows.select("kind", "made"))
        keeper = made.groupBy("kind", "made").agg(F.min(F.struct(F.xxhash64("canon"), "canon")).alias("keeps"))
        judged = made.join(keeper, ["kind", "made"]).join(taken.withColumn("real", F.lit(True)), ["kind", "made"], "left")
        judged = scratch.write(judged.select("kind", "canon", "entity", "draw", "made", (F.col("real").isNull() & (F.col("canon") == F.col("keeps.canon"))).alias("good")), f"judged-{k}")
        scratch.drop(f"round-{k}")
        settled.append(judged.where("good"))
        if judged.where("not good").isEmpty():
            break
        pending, k = judged.where("not good").select("kind", "canon", "entity", (F.col("draw") + 1).alias("draw")), k + 1
    again = settled[-1] if k else settled[0].limit(0)
    for rows in settled[1:-1]:
        again = again.union(rows)
    again = scratch.write(again.select("kind", "canon", "draw"), "redrawn")
    scratch.drop(*[f"judged-{i}" for i in range(k + 1)])
    return again


def replace_entities(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """docs with ``text`` replaced, and ``__entities``: array of (kind, original, surrogate) in order of occurrence.

    Masked values (``password=****``), scripts without an alphabet here and forms without room get free surrogates. Null texts stay
    null and empty ones empty, with no entities; texts without entities stay as they are; repeated rows
    get the same text; an empty table gives an empty one. Columns that docs has besides text pass through whatever their names are
    (names that begin with ``__`` are this module's own). One pass cuts all texts at their entities and writes them, the distinct entities
    are read from there (a hot one leaves each task once), and so are the rows of the result: the cut table stays until it is
    removed. Texts are not shuffled unless more than INLINE_REDRAWS entities were redrawn.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "surrogates")
    columns = docs.columns
    found = parted(docs)
    found = scratch.write(found.select(*[(F.when(F.col("__parts").isNull(), F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")) for c in columns], "__parts"), "cut")
    each = found.where("__parts is not null").select(F.explode(_odd(F.col("__parts"))).alias("entity"))
    kinds = each.groupBy("entity").agg(F.lit(1).alias("one")).select(entity_type(F.col("entity")).alias("kind"), "entity")
    kinds = scratch.write(kinds.withColumn("canon", canonical(F.col("kind"), F.col("entity"))), "mentions")
    distinct = scratch.write(kinds.groupBy("kind", "canon").agg(F.min("entity").alias("entity")), "entities")
    again = redraws(distinct, key, scratch)
    n = again.count()
    scratch.drop("entities")
    if n <= INLINE_REDRAWS:
        rows = again.collect()  # at most INLINE_REDRAWS rows
        scratch.drop("mentions", "redrawn")
        table = F.create_map(*[x for r in rows for x in (F.lit(f"{r['kind']}|{r['canon']}"), F.lit(r["draw"]))]) if rows else None
        draw_of = lambda kind, e: F.coalesce(F.try_element_at(table, F.concat(kind, F.lit("|"), canonical(kind, e))), F.lit(0)) if rows else F.lit(0)
    else:
        named = found.where("__parts is not null").select(F.xxhash64("__parts", F.lit(1)).alias("__a"), F.xxhash64("__parts", F.lit(2)).alias("__b"), F.explode(F.array_distinct(_odd(F.col("__parts")))).alias("entity"))
        named = named.join(kinds, "entity").join(again, ["kind", "canon"]).groupBy("__a", "__b", "kind", "canon").agg(F.max("draw").alias("draw"))
        maps = named.groupBy("__a", "__b").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "canon").alias("k"), "draw"))).alias("__draws"))
        maps = scratch.write(maps, "draws")
        scratch.drop("mentions", "redrawn")
        found = found.withColumns({"__a": F.xxhash64("__parts", F.lit(1)), "__b": F.xxhash64("__parts", F.lit(2))}).join(maps, ["__a", "__b"], "left")
        draw_of = lambda kind, e: F.coalesce(F.try_element_at(F.col("__draws"), F.concat(kind, F.lit("|"), canonical(kind, e))), F.lit(0))

    def record(e: Column) -> Column:
        return let(entity_type(e), lambda kind: F.struct(kind.alias("kind"), e.alias("original"), surrogate(kind, e, key, draw_of(kind, e)).alias("surrogate")))

    entities = F.coalesce(F.transform(_odd(F.col("__parts")), record), F.array().cast("array<struct<kind:string,original:string,surrogate:string>>"))
    out = found.withColumn("__entities", entities)
    gaps = F.filter("__parts", lambda _, i: F.pmod(i, F.lit(2)) == 0)
    joined = F.array_join(F.zip_with(gaps, F.col("__entities"), lambda g, s: F.concat(g, F.coalesce(s["surrogate"], F.lit("")))), "")
    replaced = F.when(F.col("__parts").isNull(), F.col("text")).otherwise(joined)
    return out.select(*[(replaced.alias("text") if c == "text" else F.col(f"`{c}`")) for c in columns], F.col("__entities"))
