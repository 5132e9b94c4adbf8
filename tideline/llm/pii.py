"""PII surrogates (operator 3), in DataFrame functions alone.

Entities are e-mail addresses, secrets (hex runs of 32 and more, known token shapes), IPv4
addresses, card numbers, phone and social security numbers, and persons (a title, a known given
name or an introducing phrase, then capitalised names). One regular expression finds them; a text
is its gaps and entities in turn. Lengths in the pattern are those of the formats' own standards.

Everything is drawn from HMAC-SHA256 under the caller's key.

* Numbers, IPv4 addresses and both sides of an e-mail address go through a keyed Feistel
  permutation of the strings of their format: a digit becomes a digit, a letter one of its
  script and case, marks stay. A permutation maps different entities to different surrogates, so
  distinctness needs no look at the corpus, and one entity has one surrogate however its digits
  are grouped or its letters cased. Cards keep their first digit and their Luhn remainder, phones
  with a plus sign their first digit, addresses their top-level domain.
* Secrets are replaced by keyed digits of their length (80 bits and more: no two meet).
* Names are taken apart: each part (given name, surname) has a surrogate of its own, so
  "Alice Baker" and "Mrs Baker" share a surname. A surrogate is syllables of the part's script
  and an ending; a given name's ending tells the gender of its title, else of the listed name,
  else neither.

Collision check. Syllables can meet, and can make a name that the table holds. The different
name parts of the whole table are grouped by their surrogate and ranked in one pass, real names
first; the part of rank r > 0 gets the digits of r as further syllables before the ending. Length
tells syllables from ending, so names stay distinct whatever the ranks. Only parts of a rank
over 0 are joined back to their documents, by hash of the text.

Defined results. Null text stays null, with 0 entities; an empty text stays empty. Repeated
rows: one row each. All other columns are kept as they are, whatever their names; a column with the
name asked for the count is replaced. An empty table gives an empty result. Texts of any length:
every alternative of the pattern begins at a boundary, so a long run of letters or digits is
scanned once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import kernel as K
from tideline.plans.scratch import stored

#: The query's key, for sessions that set no ``spark.tideline.surrogate.key``.
QUERY_KEY = "surrogate-key"

# Titles, common given names and introducing phrases.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    "f": """Alice Amanda Amelia Amy Andrea Angela Anna Anne Barbara Beatrice Brigitte Camille Carmen Caroline Catherine Charlotte Chloe Christina Clara Claire
        Diana Elena Elizabeth Emily Emma Eva Francesca Grace Hannah Helen Helga Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucia
        Margaret Maria Marie Martha Mary Monika Nathalie Nicole Olivia Patricia Rachel Rebecca Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria
        Анна Вера Елена Ирина Мария Наталья Ольга Татьяна Ελένη Μαρία""".split(),
    "m": """Adam Albert Alexander Andrew Anthony Antonio Bernard Brian Carlos Charles Christopher Daniel David Edward Eric Fernando Francisco Frank George Gerhard
        Hans Henri Henry Jack Jacob James Javier Jean John Jonas Jose Joseph Juan Karl Kevin Klaus Lars Louis Lucas Lukas Manuel Mark Martin Matthew Max Michael
        Miguel Nicolas Oliver Patrick Paul Pedro Peter Philip Pierre Richard Robert Samuel Sebastian Stefan Steven Thomas Walter William
        Алексей Борис Виктор Дмитрий Иван Николай Павел Сергей Γιώργος Νίκος""".split(),
}
CUES = ["my name is ", "My name is ", "Name: ", "name: ", "Contact: ", "Signed, ", "Sincerely,\n", "Regards,\n", "Dear "]
# Consonants, vowels and endings of surrogate names; all endings have 2 or 3 letters, so
# that (syllables of 2 letters, ending) is told from the name.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστφ", "αειου")}
ENDINGS = {
    ("surname", "latin"): ["ner", "son", "ler", "man", "ski", "ard", "ert", "ez", "is"], ("given f", "latin"): ["na", "la", "ra", "ssa", "tta"],
    ("given m", "latin"): ["ton", "rik", "mir", "do", "ro"], ("given n", "latin"): ["lin", "ki", "mi"],
    ("surname", "cyrillic"): ["нюк", "чук", "дзе", "ич", "ко"], ("given f", "cyrillic"): ["на", "ла", "ра", "ня"], ("given m", "cyrillic"): ["мир", "рей", "ан", "ил"], ("given n", "cyrillic"): ["шь", "ни"],
    ("surname", "greek"): ["κης", "δης", "ίδη", "ου"], ("given f", "greek"): ["να", "λα", "ρία"], ("given m", "greek"): ["νος", "ρος", "ας"], ("given n", "greek"): ["νι", "λι"],
}
#: Syllables of a surrogate of rank 0.
SIZE = {"surname": 3, "given f": 2, "given m": 2, "given n": 2}


def _trie(words: list[str]) -> str:
    """A pattern of the words that tries each beginning once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + _trie(rest) for h, rest in sorted(heads.items()) if h]
    body = parts[0] if len(parts) == 1 and "" not in heads else f"(?:{'|'.join(parts)})" if parts else ""
    return f"{body}?" if "" in heads and parts else body


_SEP = r"[ .\-#*$%&!|]{0,6}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:-\p{Lu}\p{Ll}++)*+"
_ALL_TITLES = _trie([t for ts in TITLES.values() for t in ts])
_ALL_GIVEN = _trie([n for ns in GIVEN.values() for n in ns])
_CUED = "|".join(CUES).replace("\n", r"\n")
_PERSON = rf"(?<![\p{{L}}])(?:(?:{_ALL_TITLES})\.? {_NAME}(?: {_NAME})?+|(?:{_ALL_GIVEN})(?:-\p{{Lu}}\p{{Ll}}++)?+ {_NAME}|(?<={_CUED}){_NAME} {_NAME}(?: {_NAME})?+)(?![\p{{L}}])"
# An address has at most 64 characters before the mark and 63 in a label of its domain.
_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63})++"
_SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![\p{L}\p{N}])"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_NUMBERS = "|".join([
    _IP,
    rf"(?<![\p{{L}}\p{{N}}+])\+[0-9]{{1,3}}{_SEP}\(?[0-9]{{2,4}}\)?{_SEP}[0-9]{{3,4}}{_SEP}[0-9]{{3,4}}(?![0-9])",
    r"(?<![\p{L}\p{N}+])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9])",
    r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    r"(?<![\p{L}\p{N}])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
])
_CAPITAL = rf"(?=\p{{Lu}}){_PERSON}"
# After an ASCII letter only an address can begin; elsewhere the first character rules most kinds out.
PATTERN = rf"(?<=[A-Za-z])(?=[0-9]){_IP}|(?<![A-Za-z])(?:{_EMAIL}|{_SECRET}|(?=[0-9+(])(?:{_NUMBERS})|{_CAPITAL})"
_MAYBE = rf"[0-9@]|[a-fA-F]{{32}}|AKIA|{_CAPITAL}"
_HEX, _TOKEN = r"^[0-9a-fA-F]{32,}$", r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})$"
# Characters that stand for one another, in lower case; each has one upper-case form.
_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "ёєіїўј"]
_ROUNDS = 4


# -- drawing


def _hmac(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, as 64 hex digits."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat_ws("\x1f", *parts), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _number(digest: Column, at: int, digits: int = 12) -> Column:
    return F.conv(F.substr(digest, F.lit(at), F.lit(digits)), 16, 10).cast("long")


def _bound(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of ``values``, each of them computed once."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 1)


def _feistel(left: Column, right: Column, change, size: Column, tweak: Column, key: str) -> Column:
    """A struct (a, b, size, tweak): the two halves after ``_ROUNDS`` rounds; ``change(half, digest, which, e)``
    must permute the half for each digest. Every digest is of the other half."""
    e = _bound({"a": left, "b": right, "size": size, "tweak": tweak}, lambda e: e)

    def turn_of(i: int):
        def turn(e: Column) -> Column:
            other, own = (e.b, e.a) if i % 2 == 0 else (e.a, e.b)
            new = change(own, _hmac(key, e.tweak, e["size"].cast("string"), F.lit(str(i)), F.lower(other.cast("string"))), i % 2, e)
            a, b = (new, e.b) if i % 2 == 0 else (e.a, new)
            return F.struct(a.alias("a"), b.alias("b"), e["size"].alias("size"), e.tweak.alias("tweak"))

        return turn

    for i in range(_ROUNDS):
        e = F.element_at(F.transform(F.array(e), turn_of(i)), 1)
    return e


def _digits(digits: Column, tweak: Column, key: str) -> Column:
    """A permutation of the digit strings of each length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    long = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("0")).cast("long")

    def change(own: Column, digest: Column, which: int, e: Column) -> Column:
        width = F.floor(e["size"] / 2) if which == 0 else e["size"] - F.floor(e["size"] / 2)
        room = F.pow(F.lit(10.0), width).cast("long")
        return (own + _number(digest, 1) % room) % room

    halves = _feistel(long(F.substr(digits, F.lit(1), low)), long(F.substr(digits, low + 1, n)), change, n, tweak, key)
    text = lambda e: F.concat(F.lpad(e.a.cast("string"), F.floor(e["size"] / 2).cast("int"), F.lit("0")), F.lpad(e.b.cast("string"), (e["size"] - F.floor(e["size"] / 2)).cast("int"), F.lit("0")))
    return F.element_at(F.transform(F.array(halves), text), 1)


def _shifted(text: Column, digest: Column) -> Column:
    """Each letter and digit moved within its class by a byte of the digest, case kept; marks stay."""
    def one(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        low, by = F.lower(c), F.conv(F.substr(digest, 2 * ((i - 1) % 32) + 1, F.lit(2)), 16, 10).cast("int") + F.floor((i - 1) / 32).cast("int")
        cp = F.ascii(c)
        moved = cp - cp % 64 + (cp + by) % 64  # letters of other scripts move among 64 neighbours, as they are
        other = c.rlike(r"[\p{L}\p{N}]") & ((cp >= 0x540) | cp.between(0x100, 0x33F)) & ~low.rlike("[a-z]")
        new = F.when(other, F.decode(F.unhex(F.lpad(F.hex(moved), 8, F.lit("0"))), "UTF-32")).otherwise(c)
        for chars in _CLASSES:
            at = F.instr(F.lit(chars), low)
            to = F.substr(F.lit(chars), (at - 1 + by) % len(chars) + 1, F.lit(1))
            new = F.when(at > 0, F.when(c != low, F.upper(to)).otherwise(to)).otherwise(new)
        return new

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(text)


def _letters(text: Column, tweak: Column, key: str) -> Column:
    """A permutation of the strings of each pattern of classes and marks."""
    n = F.length(text)
    low = F.floor(n / 2).cast("int")
    halves = _feistel(F.substr(text, F.lit(1), low), F.substr(text, low + 1, n), lambda own, digest, which, e: _shifted(own, digest), n, tweak, key)
    return F.element_at(F.transform(F.array(halves), lambda e: F.concat(e.a, e.b)), 1)


def _refilled(m: Column, digits: Column) -> Column:
    """``m`` with its digits exchanged for the given ones in turn."""
    def one(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(F.regexp_replace(F.substr(m, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def _luhn(digits: Column) -> Column:
    """The weighted sum of a card's digits, modulo ten."""
    def one(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, x: a + x) % 10


# -- kinds


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[0-9](?:[ \-]?[0-9]){12,18}$"), "card")
        .when(m.rlike(_HEX) | m.rlike(_TOKEN), "secret")
        .when(m.rlike("[0-9]"), "phone")
        .otherwise("person")
    )


def _number_surrogate(kind: Column, m: Column, key: str) -> Column:
    def made(e: Column) -> Column:
        n = F.length(e.digits)
        skip = F.when((e.kind == "card") | e.m.startswith("+"), 1).otherwise(0)
        last = F.when(e.kind == "card", 1).otherwise(0)
        head = F.substr(e.digits, F.lit(1), skip)
        middle = _digits(F.substr(e.digits, skip + 1, n - skip - last), F.concat(e.kind, F.lit(":"), head), key)

        def ended(x: Column) -> Column:
            check = F.pmod(_luhn(e.digits) - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")
            return F.when(e.kind == "card", F.concat(x, check)).otherwise(x)

        full = F.element_at(F.transform(F.array(F.concat(head, middle)), ended), 1)
        return F.element_at(F.transform(F.array(full), lambda x: _refilled(e.m, x)), 1)

    return _bound({"kind": kind, "m": m, "digits": F.regexp_replace(m, "[^0-9]", "")}, made)


def _ip_surrogate(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    half = lambda i: F.get(parts, F.lit(i)).cast("long") * 256 + F.get(parts, F.lit(i + 1)).cast("long")
    halves = _feistel(half(0), half(2), lambda own, digest, which, e: own.bitwiseXOR(_number(digest, 1, 4)), F.lit(4), F.lit("ip"), key)
    octets = lambda e: F.concat_ws(".", *(x.cast("int").cast("string") for h in (e.a, e.b) for x in (F.floor(h / 256), h % 256)))
    return F.element_at(F.transform(F.array(halves), octets), 1)


def _email_surrogate(m: Column, key: str) -> Column:
    def made(e: Column) -> Column:
        local = _letters(F.substring_index(e.m, "@", 1), F.concat(F.lit("email:"), F.lower(e.domain)), key)
        head = _letters(F.regexp_replace(e.domain, r"\.[^.]*$", ""), F.concat(F.lit("domain:"), F.lower(e.top)), key)
        return F.concat(local, F.lit("@"), head, e.top)

    domain = F.substring_index(m, "@", -1)
    return _bound({"m": m, "domain": domain, "top": F.regexp_extract(domain, r"\.[^.]*$", 0)}, made)


def _secret_surrogate(m: Column, key: str) -> Column:
    """Keyed hex digits, block after block; token shapes keep their first four characters and classes."""
    def made(e: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(e.m) - 1) / 64).cast("int")), lambda i: _hmac(key, F.lit("secret"), e.d, i.cast("string")))
        low = F.substr(F.array_join(blocks, ""), F.lit(1), F.length(e.m))
        plain = F.when(e.m == F.upper(e.m), F.upper(low)).otherwise(low)

        def one(i: Column) -> Column:
            c, b = F.substr(e.m, i, F.lit(1)), F.conv(F.substr(F.concat(e.d, e.d2), 2 * i - 1, F.lit(2)), 16, 10).cast("int")
            new = F.when(c.rlike("[0-9]"), F.substr(F.lit(_CLASSES[0]), b % 10 + 1, F.lit(1)))
            new = new.when(c.rlike("[a-z]"), F.substr(F.lit(_CLASSES[1]), b % 26 + 1, F.lit(1)))
            return F.when(i <= 4, c).otherwise(new.when(c.rlike("[A-Z]"), F.substr(F.lit(_CLASSES[1].upper()), b % 26 + 1, F.lit(1))).otherwise(c))

        token = F.array_join(F.transform(F.sequence(F.lit(1), F.length(e.m)), one), "")
        return F.when(e.m.rlike(_HEX), plain).otherwise(token)

    known = F.when(m.rlike(_HEX), F.lower(m)).otherwise(m)
    return _bound({"m": m, "d": _hmac(key, F.lit("secret"), known), "d2": _hmac(key, F.lit("token"), known)}, made)


# -- names


def _parts(m: Column) -> Column:
    """A person's words in turn: array of (kind, script, word)."""
    listed = lambda w, g: F.lower(F.substring_index(w, "-", 1)).isin([n.lower() for n in GIVEN[g]])

    def made(e: Column) -> Column:
        words, bare = F.split(e.rest, " "), F.regexp_replace(F.trim(e.title), r"\.$", "")
        first = F.get(words, F.lit(0))
        gender = F.when(bare.isin(TITLES["f"]), "f").when(bare.isin(TITLES["m"]), "m").when(listed(first, "f"), "f").when(listed(first, "m"), "m").otherwise("n")
        script = F.when(e.rest.rlike(r"\p{IsCyrillic}"), "cyrillic").when(e.rest.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        given = F.concat(F.lit("given "), gender)
        alone = F.when(listed(first, "f") | listed(first, "m"), given).otherwise("surname")
        kind = lambda i: F.when(F.size(words) == 1, alone).when(i < F.size(words) - 1, given).otherwise("surname")
        return F.transform(words, lambda w, i: F.struct(kind(i).alias("kind"), script.alias("script"), w.alias("word")))

    title = F.regexp_extract(m, rf"^(?:{_ALL_TITLES})\.? (?=\p{{Lu}})", 0)
    return _bound({"title": title, "rest": F.substr(m, F.length(title) + 1, F.length(m))}, made)


def _syllables(digest: Column, kind: str, script: str) -> Column:
    cons, vowels = SYLLABLES[script]
    every = F.array(*(F.lit(c + v) for c in cons for v in vowels))
    pick = [F.element_at(every, (_number(digest, 1 + 7 * i, 7) % (len(cons) * len(vowels)) + 1).cast("int")) for i in range(SIZE[kind])]
    return F.concat(*pick)


def _ending(digest: Column, kind: str, script: str) -> Column:
    ends = ENDINGS[kind, script]
    return F.element_at(F.array(*map(F.lit, ends)), (_number(digest, 40, 7) % len(ends) + 1).cast("int"))


def name_surrogate(kind: Column, script: Column, low: Column, rank: Column, key: str) -> Column:
    """What stands for a name part in lower case; ``rank`` is its rank in the collision check."""
    def made(e: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, s in ENDINGS:
            cons, vowels = SYLLABLES[s]
            digit = F.array(*(F.lit(c + vowels[0]) for c in cons[:10]))
            number = F.transform(F.split((e.rank - 1).cast("string"), ""), lambda d: F.coalesce(F.get(digit, F.try_to_number(d, F.lit("9")).cast("int")), F.lit("")))
            more = F.when(e.rank > 0, F.array_join(number, "")).otherwise("")
            out = F.when((e.kind == k) & (e.script == s), F.concat(_syllables(e.d, k, s), more, _ending(e.d, k, s))).otherwise(out)
        return F.initcap(out)

    # A given name has the same syllables whatever gender its title tells.
    base = F.substring_index(kind, " ", 1)
    return _bound({"kind": kind, "script": script, "rank": rank, "d": _hmac(key, base, script, low)}, made)


def _person_surrogate(m: Column, rank, key: str) -> Column:
    title = F.regexp_extract(m, rf"^(?:{_ALL_TITLES})\.? (?=\p{{Lu}})", 0)

    def word(p: Column) -> Column:
        segment = lambda s: name_surrogate(p.kind, p.script, F.lower(s), rank(p.kind, p.script, F.lower(s)), key)
        return F.array_join(F.transform(F.split(p.word, "-"), segment), "-")

    return F.concat(title, F.array_join(F.transform(_parts(m), word), " "))


def surrogate(m: Column, key: str, rank=None) -> Column:
    """What stands for entity ``m``; ``rank(kind, script, low)`` of a name part, 0 if not given."""
    rank = rank or (lambda kind, script, low: F.lit(0))

    def made(e: Column) -> Column:
        out = F.when(e.kind == "email", _email_surrogate(e.m, key)).when(e.kind == "ip", _ip_surrogate(e.m, key))
        out = out.when(e.kind == "secret", _secret_surrogate(e.m, key)).when(e.kind == "person", _person_surrogate(e.m, rank, key))
        return out.otherwise(_number_surrogate(e.kind, e.m, key))

    return _bound({"kind": kind_of(m), "m": m}, made)


def _name_parts(persons: DataFrame, *keep: str) -> DataFrame:
    """(keep, kind, script, low) of the name parts of ``persons`` (keep, m)."""
    words = persons.select(*keep, F.explode(_parts(F.col("m"))).alias("p"))
    return words.select(*keep, "p.kind", "p.script", F.explode(F.split(F.lower("p.word"), "-")).alias("low"))


def _persons(docs: DataFrame, *keep: Column) -> DataFrame:
    found = docs.where(F.col("text").rlike(_CAPITAL)).select(*keep, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))).alias("m"))
    return found.where(kind_of(F.col("m")) == "person")


def ranks(parts: DataFrame, key: str) -> DataFrame:
    """(kind, script, low, rank) of the name parts whose surrogate is another's or a real name; one pass."""
    parts = parts.select("kind", "script", "low").distinct()
    own = parts.withColumn("base", F.lower(name_surrogate(F.col("kind"), F.col("script"), F.col("low"), F.lit(0), key))).withColumn("real", F.lit(False))
    real = parts.select("kind", "script", "low", F.col("low").alias("base"), F.lit(True).alias("real"))
    place = F.expr("row_number() over (partition by kind, script, base order by real desc, low) - 1")
    return own.union(real).withColumn("rank", place).where("not real and rank > 0").select("kind", "script", "low", "rank")


def replace(docs: DataFrame, key: str, count: str | None = "n_entities") -> DataFrame:
    """``docs``, all columns, entities replaced in ``text``; and their number, unless ``count`` is None."""
    h, found, held = K.fresh(docs, "text_hash", "found", "ranks")
    later = stored(ranks(_name_parts(_persons(docs)), key), "ranks")
    rows, rank = docs, None
    if not later.isEmpty():
        own = _name_parts(_persons(docs, F.xxhash64("text").alias(h)), h).join(later, ["kind", "script", "low"])
        maps = own.select(h, F.struct(F.concat_ws(" ", "kind", "script", "low").alias("k"), "rank").alias("e"))
        maps = maps.groupBy(h).agg(F.map_from_entries(F.collect_set("e")).alias(held))
        rows = docs.withColumn(h, F.xxhash64("text")).join(maps, h, "left")
        rank = lambda kind, script, low: F.coalesce(F.try_element_at(F.col(held), F.concat_ws(" ", kind, script, low)), F.lit(0))
    all_ = F.when(F.col("text").rlike(_MAYBE), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    rows = rows.withColumn(found, F.when(F.size(all_) > 0, all_))
    new = F.concat(F.transform(found, lambda m: surrogate(m, key, rank)), F.array(F.lit("")))
    text = F.array_join(F.flatten(F.zip_with(F.split("text", PATTERN, -1), new, lambda g, s: F.array(g, s))), "")
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.when(F.col(found).isNotNull(), text).otherwise(F.col("text"))}
    if count:
        out[next((c for c in docs.columns if c.lower() == count.lower()), count)] = F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0)).cast("long")
    return rows.select(*(v.alias(k) for k, v in out.items()))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.tideline.surrogate.key", QUERY_KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))
