"""Personal data replaced by surrogates of the same type and format.

One pattern finds e-mail addresses, IPv4 and IPv6 addresses, account and card numbers, phone
numbers, secrets, and names after a title, with a known given name or in a phrase that
introduces one. It runs once over every text; in a text that names somebody, their surnames and
known given names are then found again where they stand alone. The text's parts are written, so
that later steps read the mentions instead of looking for them again. Every entity gets a
surrogate that is a keyed hash of its canonical form alone, so mentions of one entity agree
across documents and formats (coreference): phone numbers with and without the country code 1,
IPv6 addresses short and in full, IPv4 with and without leading zeros. A name is two entities,
given name and surname: "Mr John Smith", "John Smith", "Mr Smith" and a later "Smith" share
theirs; a genitive 's is no part of a name.

The distinct entities of all documents are checked, kind by kind, for surrogates that meet and
for surrogates that are entities themselves; these are drawn anew until none is left.

Kept: separators, country codes and the issuer's first digit, the lengths of numbers and
secrets, letter case, titles, the script of a name, its gender (by title or given name; male
surrogates of given names end in a consonant, female ones in a vowel), the kind of a domain.
Surrogates of IBANs, and of cards whose check digit holds, have valid check digits; IPv6
addresses go to the range for documentation, private IPv4 ones to 10/8 and others to the
reserved 240/4, so that none is anybody's (the documentation ranges hold too few to stay
distinct). The key is an argument: who has it can test a
guess, but not invert a surrogate. The main path is SQL functions only.

Defined cases: a null text stays null with no entities; texts without entities stay as they
are, of any length; a surname alone is found only in a text that also introduces it; a word
alone that is a known given name counts as one, even if it was introduced as a surname; four
numbers of which one exceeds 255 are no address; a phone number in a national form of another
country than that of code 1 is an entity of its own; the search for words alone takes time in
the capitalised words times the distinct names of a text; repeated rows get equal texts; of tied entities the first by canonical form keeps its surrogate; extra
columns stay, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import written

# Titles that precede a name, by gender.
TITLES = {"m": ("Mr", "Herr", "M", "Monsieur", "Señor", "Sr", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Госпожа")}
# Common given names, by gender.
GIVEN = {
    "m": ("Andrew", "Carlos", "Charles", "Christopher", "Daniel", "David", "Dieter", "Edward", "François", "George", "Hans", "Heinrich", "James", "John", "Joseph", "José", "Jürgen", "Klaus", "Matthew", "Michael", "Michel", "Miguel", "Pedro", "Philippe", "Pierre", "Richard", "Robert", "Thomas", "William", "Wolfgang", "Алексей", "Дмитрий", "Иван", "Сергей"),
    "f": ("Barbara", "Brigitte", "Carmen", "Catherine", "Elizabeth", "Emily", "Heike", "Isabel", "Isabelle", "Jennifer", "Jessica", "Karen", "Laura", "Linda", "Lucía", "Margaret", "María", "Mary", "Monika", "Nathalie", "Patricia", "Petra", "Sabine", "Sarah", "Sophie", "Susan", "Ursula", "Анна", "Елена", "Мария", "Ольга"),
}


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


_TITLE, _GIVEN = _any(TITLES["m"] + TITLES["f"]), _any(GIVEN["m"] + GIVEN["f"])
_E, _START, _END = r"\p{L}\p{N}._%+\-", r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_WORD, _HEX = r"\p{Lu}(?:\p{L}|['’\-](?=\p{L})(?!s(?!\p{L})))+", "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
#: What introduces a name of any words.
_CONTEXT = r"(?<=(?:[Mm]y name is|[Ss]igned by|[Ss]incerely,|[Rr]egards,)[ \n])"
#: Around a name's word that stands alone.
_ALONE, _ENDED = r"(?<![\p{L}\p{N}'’\-])(?=\p{Lu})", r"(?![\p{L}\p{N}])(?!['’\-](?!s(?!\p{L}))\p{L})"
_SECRET = r"(?:sk|pk|ghp|gsk|xox[abp])[_\-]"
#: Kind and pattern, in order of precedence.
PATTERNS = (
    ("email", rf"(?<![{_E}])[{_E}]++@[\p{{L}}\p{{N}}\-]+(?:\.[\p{{L}}\p{{N}}\-]+)*\.\p{{L}}{{2,24}}"),
    ("ip6", rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f:]{{6}})(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:])"),
    ("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"),
    ("iban", rf"{_START}(?=[A-Z]{{2}}(?:[A-Z ]{{0,8}}\d){{8}})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"),
    ("secret", rf"{_START}(?:{_SECRET}[A-Za-z0-9_\-]{{16,}}|AKIA[A-Z0-9]{{16}}|(?=[a-f]*\d)(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}})){_END}"),
    ("card", r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])"),
    ("number", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("name", rf"{_START}(?:{_TITLE}\.? {_WORD}(?: {_WORD})?|{_GIVEN} {_WORD}|{_CONTEXT}{_WORD}(?: {_WORD})?)"),
)
#: What a mention of a kind may begin with: most characters of a text are passed by these alone.
_FIRST = {"email": "", "ip6": "(?=[0-9A-Fa-f:])", "iban": "(?=[A-Z])", "secret": "(?=[A-Z0-9a-fskpgx])", "name": r"(?=\p{Lu})"}
#: Any of the kinds; those that begin with a digit, a plus or a bracket share their test.
ANY = "|".join([*(f"{_FIRST[k]}(?:{p})" for k, p in PATTERNS[:5] if k != "ip"), r"(?=[\d+(])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS if k in ("ip", "card", "phone", "number")) + ")", f"{_FIRST['name']}(?:{PATTERNS[-1][1]})"])
#: Around a mention, and before what the text itself holds of the two.
_MARK, _ESCAPE = "\u0001", "\u0002"
_TRIES = 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times."""
    return F.transform(F.array(value), body)[0]


def is_in(word: Column, names) -> Column:
    return F.array_contains(F.array(*map(F.lit, names)), word)


def kind_of(mention: Column) -> Column:
    """A mention's kind; without its surroundings a name may fit no pattern."""
    kind = F.when(mention.contains(" "), "name").when(is_in(mention, GIVEN["m"]), "given-m").when(is_in(mention, GIVEN["f"]), "given-f").otherwise("surname")
    for name, pattern in reversed(PATTERNS):
        kind = F.when(mention.rlike(rf"\A(?:{pattern})\z"), name).otherwise(kind)
    return kind


def canonical(mention: Column, kind: Column) -> Column:
    """The form that mentions of one entity share; names see ``name_parts``."""
    number = F.regexp_replace(mention, "[^0-9]", "")
    # Numbers with country code 1 in the form without it; others with a plus.
    phone = F.when(~mention.startswith("+"), number).when((F.length(number) == 11) & number.startswith("1"), F.substring(number, 2, 10)).otherwise(F.concat(F.lit("+"), number))
    return (
        F.when(kind == "ip6", full_ip6(F.lower(mention))).when(kind.isin("email", "surname", "given-m", "given-f"), F.lower(mention)).when(kind == "secret", mention)
        .when(kind == "ip", F.regexp_replace(mention, r"(?<!\d)0+(?=\d)", "")).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind == "phone", phone).otherwise(number)
    )


def full_ip6(address: Column) -> Column:
    """Eight groups of four digits."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    halves = F.split(address, "::", 2)
    whole = lambda head, tail: F.concat(head, F.array_repeat(F.lit("0"), 8 - F.size(head) - F.size(tail)), tail)
    padded = let(halves, lambda h: let(groups(h[0]), lambda a: let(groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))), lambda b: whole(a, b))))
    return F.array_join(F.transform(padded, lambda g: F.lpad(g, 4, "0")), ":")


def name_parts(mention: Column) -> Column:
    """Struct (title, given, surname, gender): title with the space after it; given may be null."""
    title = F.regexp_extract(mention, rf"\A{_TITLE}\.? ", 0)
    words = F.split(F.regexp_replace(mention, rf"\A{_TITLE}\.? ", ""), " ")
    bare = F.regexp_replace(title, r"\.? \z", "")

    def parts(w: Column) -> Column:
        gender = F.when(title != "", F.when(is_in(bare, TITLES["f"]), "f").otherwise("m")).when(is_in(w[0], GIVEN["f"]), "f").otherwise("m")
        return F.struct(title.alias("title"), F.when(F.size(w) > 1, w[0]).alias("given"), F.element_at(w, -1).alias("surname"), gender.alias("gender"))

    return let(words, parts)


def entities_of(mention: Column) -> Column:
    """Array of (kind, canon) of a mention; given names are told apart by gender."""
    entity = lambda kind, canon: F.struct(kind.alias("kind"), canon.alias("canon"))
    of_name = lambda p: F.filter(F.array(entity(F.lit("surname"), F.lower(p["surname"])), entity(F.concat(F.lit("given-"), p["gender"]), F.lower(p["given"]))), lambda e: e["canon"].isNotNull())
    return let(kind_of(mention), lambda k: F.when(k == "name", let(name_parts(mention), of_name)).otherwise(F.array(entity(k, canonical(mention, k)))))


def hash_of(kind: Column, canon: Column, tries: Column, key: str) -> Column:
    """128 hexadecimal digits."""
    one = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, tries.cast("string")), 256)
    return let(one, lambda h: F.concat(h, F.sha2(h, 256)))


def digits(hexed: Column, n: Column, first: int = 1) -> Column:
    return F.substring(F.translate(hexed, "abcdef", "135790"), F.lit(first), n)


def syllables(hexed: Column, n: int, cyrillic: Column, coda: str = "") -> Column:
    """n syllables, and a last consonant or vowel for a gender."""
    hexes = "0123456789abcdef"

    def made(consonants: str, vowels: str) -> Column:
        at = lambda k, to: F.translate(F.substring(hexed, k + 1, 1), hexes, to)
        end = {"m": [at(2 * n, consonants)], "f": [at(2 * n, consonants), F.lit(vowels[0])], "": []}[coda]
        return F.concat(*(at(2 * k + j, (consonants, vowels)[j]) for k in range(n) for j in (0, 1)), *end)

    return F.when(cyrillic, made("бвгдзклмнпрстфхш", "аеиоуаеиоуаеиоуа")).otherwise(made("bcdfghklmnprstvz", "aeiouaeiouaeioua"))


def luhn(number: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits; 0 for a valid one."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(number), ""), lambda c, k: F.when(k % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10


def modulo_97(account: Column) -> Column:
    """The remainder that an IBAN's check is taken from; letters count from 10."""
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(account, ""), F.lit(0), lambda a, c: step(a, c))


def drawn(kind: Column, canon: Column, hexed: Column, width: int = 16) -> Column:
    """The canonical form of the surrogate of an entity, from 128 hexadecimal digits."""
    n = F.length(canon)
    tail = F.regexp_extract(canon, r"\.([^.]+)\z", 1)
    email = F.concat(F.translate(F.substring(hexed, 1, width), "0123456789abcdef", "bcdfghklmnprstvz"), F.lit("@mail.example."), F.when(tail.isin("com", "org", "net"), tail).otherwise("com"))
    byte = lambda k: F.conv(F.substring(hexed, 2 * k + 1, 2), 16, 10)
    private = canon.rlike(r"\A(?:10|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
    ip = F.concat_ws(".", F.when(private, "10").otherwise((byte(0).cast("int") % 15 + 240).cast("string")), byte(1), byte(2), byte(3))
    ip6 = F.concat(F.lit("2001:0db8:"), F.concat_ws(":", *(F.substring(hexed, 4 * k + 1, 4) for k in range(6))))
    letters = F.translate(hexed, "0123456789abcdef", "ABCDEFGHJKLMNPQR")
    body = F.array_join(F.transform(F.split(F.substring(canon, F.lit(5), n), ""), lambda c, k: F.when(c.between("0", "9"), digits(hexed, F.lit(1), k + 1)).otherwise(F.substring(letters, k + 1, F.lit(1)))), "")
    iban = let(body, lambda b: F.concat(F.substring(canon, 1, 2), F.lpad((98 - modulo_97(F.concat(b, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
    lead = F.regexp_extract(canon, rf"\A(?:{_SECRET}|AKIA)", 0)
    secret = F.when(canon.rlike(r"\A[0-9a-f]+\z"), F.substring(hexed, F.lit(1), n)).otherwise(F.concat(lead, F.upper(F.substring(hexed, F.lit(1), n - F.length(lead)))))
    valid = let(F.concat(F.substring(canon, 1, 1), digits(hexed, n - 2)), lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
    card = F.when(luhn(canon) == 0, valid).otherwise(F.concat(F.substring(canon, 1, 1), digits(hexed, n - 1)))
    phone = let(F.least(n - F.when(canon.startswith("+"), 1).otherwise(0), F.lit(10)), lambda own: F.concat(F.substring(canon, F.lit(1), n - own), digits(hexed, own)))
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "iban", iban).when(kind == "secret", secret).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "surname", syllables(hexed, 4, cyrillic)).when(kind == "given-m", syllables(hexed, 3, cyrillic, "m")).when(kind == "given-f", syllables(hexed, 3, cyrillic, "f")).otherwise(digits(hexed, n))
    )


def refilled(shape: Column, to: Column) -> Column:
    """The mention with its letters and digits replaced one by one."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike("[A-Z0-9]"), F.struct(F.concat(a["s"], F.substring(to, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), start, step, lambda a: a["s"])


def surrogate(mention: Column, tries: Callable[[Column, Column], Column], key: str, width: int = 16) -> Column:
    """The replacement of a mention; tries(kind, canon) says how often its entity was drawn anew."""
    to = lambda kind, canon: let(hash_of(kind, canon, tries(kind, canon), key), lambda h: drawn(kind, canon, h, width))
    cased = lambda word, made: F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(made)).otherwise(F.initcap(made))
    given = lambda p: F.when(p["given"].isNotNull(), F.concat(cased(p["given"], to(F.concat(F.lit("given-"), p["gender"]), F.lower(p["given"]))), F.lit(" "))).otherwise("")
    name = let(name_parts(mention), lambda p: F.concat(p["title"], given(p), cased(p["surname"], to(F.lit("surname"), F.lower(p["surname"])))))
    # The country code 1 of the mention, which the canonical form leaves out.
    dialled = lambda x: F.when(x.startswith("+"), F.substring(x, F.lit(2), F.length(x))).when(mention.startswith("+"), F.concat(F.lit("1"), x)).otherwise(x)
    plain = lambda k: let(to(k, canonical(mention, k)), lambda x: (
        F.when(k.isin("iban", "card", "number"), refilled(mention, x)).when(k == "phone", refilled(mention, dialled(x))).when(k == "ip6", F.regexp_replace(x, r"(?<![0-9a-f])0+(?=[0-9a-f])", ""))
        .when(k.isin("surname", "given-m", "given-f"), cased(mention, x)).otherwise(x)
    ))
    return let(kind_of(mention), lambda k: F.when(k == "name", name).otherwise(plain(k)))


def parts_of(text: Column) -> Column:
    """The text cut around its mentions, which stand at the odd places; null for null.

    Marks that the text itself holds are escaped, so that the parts can be joined again.
    """
    escaped = F.when(text.contains(_MARK) | text.contains(_ESCAPE), F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "\u0004")), F.lit(_MARK), F.lit(_ESCAPE + "\u0003"))).otherwise(text)
    marked = F.regexp_replace(escaped, ANY, f"{_MARK}$0{_MARK}")
    return let(F.split(marked, _MARK, -1), with_names_alone)


def with_names_alone(parts: Column) -> Column:
    """Parts in which the surnames and known given names of the text's mentions are mentions wherever they stand."""
    words = lambda m: let(F.split(F.regexp_replace(m, rf"\A{_TITLE}\.? ", ""), " "), lambda w: F.array(F.element_at(w, -1), F.when(is_in(w[0], GIVEN["m"] + GIVEN["f"]), w[0])))
    named = F.filter(mentions(parts), lambda m: m.rlike(r"\A\p{Lu}[\p{L} .'’\-]+\z"))
    names = F.array_distinct(F.array_compact(F.flatten(F.transform(named, words))))
    pattern = lambda n: F.concat(F.lit(_ALONE + "(?:"), F.array_join(F.array_distinct(F.concat(n, F.transform(n, F.upper))), "|"), F.lit(")" + _ENDED))
    again = lambda p: F.split(F.array_join(F.transform(parts, lambda x, k: F.when(k % 2 == 0, F.regexp_replace(x, p, f"{_MARK}$0{_MARK}")).otherwise(x)), _MARK), _MARK, -1)
    return let(names, lambda n: F.when(F.size(n) > 0, let(pattern(n), again)).otherwise(parts))


def joined(parts: Column) -> Column:
    """The text of parts."""
    plain = F.array_join(parts, "")
    return F.when(plain.contains(_ESCAPE), F.replace(F.replace(plain, F.lit(_ESCAPE + "\u0003"), F.lit(_MARK)), F.lit(_ESCAPE + "\u0004"), F.lit(_ESCAPE))).otherwise(plain)


def mentions(parts: Column) -> Column:
    return F.filter(parts, lambda x, k: k % 2 == 1)


def redrawn(found: DataFrame, parts: str, key: str, width: int = 16) -> DataFrame:
    """(kind, canon, tries) of the entities that must be drawn anew so that no surrogates meet."""
    said = found.select(F.explode(mentions(F.col(parts))).alias("m")).distinct()
    known = written(said.select(F.explode(entities_of(F.col("m"))).alias("e")).select("e.kind", "e.canon").distinct().withColumn("tries", F.lit(0)), "entities")
    for _ in range(_TRIES):
        made = known.select("kind", "canon", "tries", drawn(F.col("kind"), F.col("canon"), hash_of(F.col("kind"), F.col("canon"), F.col("tries"), key), width).alias("s"))
        # Of entities that meet, the first by (tries, canon) keeps its surrogate; none may take another's name.
        keeps = made.groupBy("kind", "s").agg(F.min(F.struct(-F.col("tries"), "canon")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("kind", "s", F.col("first.canon").alias("winner"))
        real = known.select("kind", F.col("canon").alias("s"), F.lit(True).alias("real"))
        again = written(made.join(keeps, ["kind", "s"], "left").join(real, ["kind", "s"], "left").filter("real or (winner is not null and winner != canon)").select("kind", "canon"), "again")
        if again.isEmpty():
            return known.filter("tries > 0")
        known = written(known.join(again.withColumn("again", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", (F.col("tries") + F.coalesce("again", F.lit(0))).alias("tries")), "entities")
    raise ValueError("surrogates still meet: draw them from more letters")


def _unused(taken, name: str) -> str:
    while name in taken:
        name += "_"
    return name


def pseudonymised(docs: DataFrame, key: str, width: int = 16, count: str | None = None) -> DataFrame:
    """The documents with every entity replaced; ``count`` names a column for the entities' number."""
    if not key:
        raise ValueError("a secret key is needed")
    out = [c for c in docs.columns if c != count]
    parts, row, drawn_anew = (_unused(docs.columns, c) for c in ("parts", "row", "tries"))
    found = written(docs.select(*(docs[c] for c in out if c != "text"), F.monotonically_increasing_id().alias(row), parts_of(F.col("text")).alias(parts)), "parts")
    again, of = redrawn(found, parts, key, width), lambda kind, canon: F.lit(0)
    if not again.isEmpty():
        said = found.select(row, F.explode(mentions(F.col(parts))).alias("m")).select(row, F.explode(entities_of(F.col("m"))).alias("e")).select(F.col(row).alias("row"), "e.kind", "e.canon").distinct()
        own = said.join(again, ["kind", "canon"]).groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "tries"))).alias(drawn_anew))
        found = found.join(own, row, "left")
        of = lambda kind, canon: F.coalesce(F.try_element_at(drawn_anew, F.concat_ws("|", kind, canon)), F.lit(0))
    n = F.coalesce(F.floor(F.size(F.col(parts)) / 2), F.lit(0)).cast("long")
    replaced = F.transform(F.col(parts), lambda x, k: F.when(k % 2 == 1, surrogate(x, of, key, width)).otherwise(x))
    text = F.when(F.col(parts).isNotNull(), joined(F.when(n > 0, replaced).otherwise(F.col(parts))))
    told = _unused([*docs.columns, parts, row, drawn_anew], "told")
    chars = F.when(n > 0, F.length(told).cast("long")).otherwise(F.col("n_chars")) if dict(docs.dtypes).get("n_chars") == "bigint" else None
    done = found.select("*", text.alias(told))
    of_column = lambda c: F.col(told).alias(c) if c == "text" else chars.alias(c) if c == "n_chars" and chars is not None else F.col(c)
    return done.select(*map(of_column, out), *([F.greatest(n, F.lit(0)).alias(count)] if count else []))
