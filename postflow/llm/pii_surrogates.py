"""Personal data replaced by keyed surrogates of the same type and form.

**Detection.** One pattern finds mail addresses, IP addresses, card, phone, social security and bank account numbers,
access keys, secrets behind a name, and names of persons (a title or a known given name, then a capitalised word).

**Surrogates.** A keyed Feistel network over the characters of a value shifts each character within its class (digits,
small letters, capitals; hexadecimal digits in hexadecimal values), so lengths, separators and classes stay, and two
values of one form can't get one surrogate. Cards keep the first digit and whether their check digit is right, phone
numbers keep country and first digit, IP addresses the first octet, mail addresses the last label of their domain, and
all addresses of a domain get one domain. Names of persons keep their title, and get a given name of the same gender and
script and a family name of that script, made of syllables.

**Coreference.** Values are brought to a canonical form first (digits of a number, small letters of an address or name),
and one canonical form has one surrogate in all documents and spellings.

**Collision checks.** All distinct values of the corpus get their surrogates, and where two values share one, or one is
itself a value of the corpus, all but the first are keyed anew until none is left.

Everything is column expressions. What is shuffled are the distinct values, and for each document with some of them a map
of its surrogates. These maps meet the texts by document id: by a broadcast if there are few, else by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import aside, small, text_of, written

# Names and syllables of surrogates, titles, patterns.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Peter Paul Hans Karl Jean Pierre Luis Carlos Marco Stefan Martin Oliver".split(),
    ("latin", "f"): "Mary Anna Linda Susan Karen Sarah Laura Julia Emma Claire Marie Elena Carmen Lucia Ingrid Petra Sophie Nina Helen Diana".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Николай Михаил Олег Павел Юрий Борис".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана Юлия Вера".split(),
    ("greek", "m"): "Γιώργος Νίκος Γιάννης Κώστας Δημήτρης Πέτρος".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Ειρήνη".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve wa we".split(),
    "cyrillic": "ба бо ва ве га го да де до за ка ко ла ле ло ма мо на не но па по ра ро са со та то".split(),
    "greek": "βα γα δα δο θα κα κο λα λο μα μο να νο πα πο ρα ρο σα σο τα το".split(),
}
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita Sra Госпожа Κυρία".split(),
    "n": "Dr Prof Professor Doctor".split(),
}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_KNOWN = "|".join(g for names in GIVEN.values() for g in names)
#: In front of a capital at the beginning of a word; looked at first, as few characters are capitals.
_CAPITAL = r"(?=[A-ZÀ-ÞА-ЯΆ-Ω])(?<!\p{L})"
_CAPITALISED = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: Kinds of values in the order in which they are tried.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?=[PpTtSsAa])(?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9_/+-]{8,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9+-])[1-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": (
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
        r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    ),
    "name": rf"{_CAPITAL}(?:(?:{_TITLE})\.? {_CAPITALISED}(?: {_CAPITALISED})?|(?:{_KNOWN}) {_CAPITALISED})(?![\p{{L}}])",
}
#: What every value has in it. Texts without are not searched further.
HINT = rf"[0-9@=:]|{_CAPITAL}(?:{_TITLE}|{_KNOWN})(?!\p{{L}})"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# End of fixed values.

PATTERN = "(?:" + "|".join(KINDS.values()) + ")"
ROUNDS = 4
#: Keys tried for a value before a run gives up; the chance to need another falls with each.
MAX_ATTEMPTS = 20


def _kind(value: Column) -> Column:
    kinds = [F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)) for kind, pattern in KINDS.items()]
    return F.coalesce(*kinds, F.lit("name"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _secret_value(value: Column) -> Column:
    return F.regexp_extract(value, r"[=:] ?[\"']?(.*)$", 1)


def canonical(kind: Column, value: Column) -> Column:
    """What all spellings of one value have in common. Phone numbers lose the country code of North America."""
    digits = _digits(value)
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", F.regexp_replace(digits, "^1(?=[0-9]{10}$)", ""))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "secret", _secret_value(value))
        .when(kind == "name", F.lower(F.regexp_replace(value, rf"^(?:{'|'.join(TITLES['m'] + TITLES['f'] + TITLES['n'])})\.? ", "")))
        .otherwise(value)
    )


def _number(digest: Column, i: Column | int, size: int) -> Column:
    """The i-th number below ``size`` that a digest gives; three hexadecimal digits each, read in a circle."""
    at = F.expr("1") + 3 * (F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(21)))
    return F.pmod(F.conv(F.substring(digest, at, F.lit(3)), 16, 10).cast("int"), F.lit(size))


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def _position(characters: str, c: Column) -> Column:
    """From 1; 0 if it isn't one of them."""
    return F.position(c, F.lit(characters))


def _shifted(text: Column, digest: Column, classes: tuple[str, ...]) -> Column:
    """Each character shifted within its class by the numbers of a digest."""

    def shift(i: Column) -> Column:
        c = F.substring(text, i + 1, F.lit(1))
        moved = [
            F.when(_position(chars, c) > 0, F.substring(F.lit(chars), 1 + F.pmod(_position(chars, c) - 1 + _number(digest, i, len(chars)), F.lit(len(chars))), F.lit(1)))
            for chars in classes
        ]
        return F.coalesce(*moved, c)

    return F.when(F.char_length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.char_length(text) - 1), shift), "")).otherwise("")


def feistel(text: Column, key: Column, classes: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """A keyed permutation of the texts of one form: lengths, classes of characters and other characters stay."""
    half = F.expr("1") * F.floor((F.char_length(text) + 1) / 2).cast("int")
    halves = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.char_length(text)).alias("b"))

    def turn(so_far: Column, i: Column) -> Column:
        # in turn one half is shifted by what the other says
        even = F.pmod(i, F.lit(2)) == 0
        a = F.when(even, _shifted(so_far["a"], _digest(key, i.cast("string"), so_far["b"]), classes)).otherwise(so_far["a"])
        b = F.when(even, so_far["b"]).otherwise(_shifted(so_far["b"], _digest(key, i.cast("string"), so_far["a"]), classes))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda x: F.concat(x["a"], x["b"]))


def _luhn(digits: Column) -> Column:
    """The check digit behind some digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        double = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        return total + F.when(F.pmod(i, F.lit(2)) == 0, double).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _part(text: Column, start: Column | int, length: Column | int) -> Column:
    return F.substring(text, start if isinstance(start, Column) else F.lit(start), length if isinstance(length, Column) else F.lit(length))


def _card(digits: Column, key: Column) -> Column:
    body = _part(digits, 1, F.char_length(digits) - 1)
    new = F.concat(_part(digits, 1, 1), feistel(_part(body, 2, F.char_length(body)), key, (DIGITS,)))
    off = F.pmod(_part(digits, F.char_length(digits), 1).cast("int") - _luhn(body), F.lit(10))
    return F.concat(new, F.pmod(_luhn(new) + off, F.lit(10)).cast("string"))


def _national(digits: Column, key: Column) -> Column:
    """A phone number: country code and first digit stay."""
    kept = F.greatest(F.char_length(digits) - 10, F.lit(0)) + 1
    return F.concat(_part(digits, 1, kept), feistel(_part(digits, kept + 1, F.char_length(digits)), key, (DIGITS,)))


def _ip(value: Column, key: Column) -> Column:
    octets = F.split(value, r"\.")
    hexed = F.concat(*[F.lpad(F.lower(F.hex(F.get(octets, F.lit(k)).cast("long"))), 2, "0") for k in (1, 2, 3)])
    new = feistel(hexed, key, (DIGITS + "abcdef",))
    return F.concat_ws(".", F.get(octets, F.lit(0)), *[F.conv(_part(new, 2 * k + 1, 2), 16, 10) for k in range(3)])


def _email(value: Column, key: Column, secret: str) -> Column:
    """Local part and domain have keys of their own. Short local parts, of which there are few, are made longer."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    last = F.substring_index(domain, ".", -1)
    rest = _part(domain, 1, F.char_length(domain) - F.char_length(last))
    tail = _digest(key, "tail", value)
    longer = F.concat(F.lit("."), *[F.substring(F.lit(LOWER), 1 + _number(tail, k, 26), F.lit(1)) for k in range(6)])
    new = F.concat(feistel(local, key), F.when(F.char_length(local) < 6, longer).otherwise(""))
    return F.concat(new, F.lit("@"), feistel(rest, F.lit(f"{secret}|domain")), last)


def _gender_and_script(value: Column) -> tuple[Column, Column]:
    script = F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(value.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise("latin")
    female = "|".join(TITLES["f"] + [g for (_, gender), names in GIVEN.items() if gender == "f" for g in names])
    male = "|".join(TITLES["m"] + [g for (_, gender), names in GIVEN.items() if gender == "m" for g in names])
    gender = F.when(value.rlike(rf"(?iu)(?<!\p{{L}})(?:{female})(?!\p{{L}})"), F.lit("f")).when(value.rlike(rf"(?iu)(?<!\p{{L}})(?:{male})(?!\p{{L}})"), F.lit("m")).otherwise("n")
    return gender, script


def _person(name: Column, gender: Column, key: Column) -> Column:
    """``name`` without title; two words get a given and a family name, one word a family name."""
    _, script = _gender_and_script(name)
    digest = _digest(key, name)
    either = F.when(_number(digest, 0, 2) == 0, F.lit("m")).otherwise("f")
    gender = F.when(gender == "n", either).otherwise(gender)

    def chosen(values: list[str], i: int) -> Column:
        return F.get(F.array(*map(F.lit, values)), _number(digest, i, len(values)))

    given = F.coalesce(*[F.when((script == s) & (gender == g), chosen(names, 1)) for (s, g), names in GIVEN.items()])
    family = F.coalesce(*[F.when(script == s, F.initcap(F.concat(*[chosen(parts, 2 + k) for k in range(5)]))) for s, parts in SYLLABLES.items()])
    return F.when(F.contains(name, F.lit(" ")), F.concat(given, F.lit(" "), family)).otherwise(family)


def surrogate(kind: Column, value: Column, gender: Column, attempt: Column, secret: str) -> Column:
    """The surrogate of a canonical value, in canonical form."""
    key = F.concat(F.lit(f"{secret}|"), kind, F.lit("|"), attempt.cast("string"))
    hexadecimal = value.rlike("^[0-9a-f]+$")
    return (
        F.when(kind == "email", _email(value, key, secret))
        .when(kind == "card", _card(value, key))
        .when(kind == "phone", _national(value, key))
        .when(kind == "ssn", feistel(value, key, (DIGITS,)))
        .when(kind == "ip", _ip(value, key))
        .when(kind == "iban", F.concat(_part(value, 1, 2), feistel(_part(value, 3, F.char_length(value)), key, (DIGITS, UPPER))))
        .when(kind == "aws", F.concat(F.lit("AKIA"), feistel(_part(value, 5, 16), key, (UPPER + DIGITS,))))
        .when((kind == "secret") & hexadecimal, feistel(value, key, (DIGITS + "abcdef",)))
        .when(kind == "secret", feistel(value, key))
        .otherwise(_person(value, gender, key))
    )


def _in_form(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate in the spelling of the value: separators, what stands before a secret, the title of a name."""

    def placed(template: Column, characters: Column, pattern: str) -> Column:
        # the last characters of both belong together; what is left of the template before them stays (a country code)
        def one(i: Column) -> Column:
            c = F.substring(template, i + 1, F.lit(1))
            behind = F.char_length(F.regexp_replace(F.substring(template, i + 2, F.char_length(template)), f"[^{pattern}]", ""))
            at = F.char_length(characters) - behind
            return F.when(c.rlike(f"[{pattern}]") & (at > 0), F.substring(characters, at, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.char_length(template) - 1), one), "")

    title = F.regexp_extract(value, rf"^(?:{_TITLE})\.? ", 0)
    return (
        F.when(kind.isin("card", "phone", "ssn"), placed(value, new, "0-9"))
        .when(kind == "iban", placed(value, new, "A-Z0-9"))
        .when(kind == "secret", F.concat(_part(value, 1, F.char_length(value) - F.char_length(_secret_value(value))), new))
        .when(kind == "name", F.concat(title, new))
        .otherwise(new)
    )


def _matches(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def _described(value: Column) -> Column:
    """Kind, canonical form and gender of a match."""
    kind = _kind(value)
    gender = F.when(kind == "name", _gender_and_script(value)[0]).otherwise("n")
    return F.struct(kind.alias("kind"), canonical(kind, value).alias("value"), gender.alias("gender"), value.alias("spelling"))


def assigned(known: DataFrame, secret: str) -> DataFrame:
    """The surrogate of every value: ``kind``, ``value``, ``new``. No two values of a kind share one, and none is a
    value itself; what collides is keyed anew, all but the first."""
    state = known.withColumn("attempt", F.lit(0))
    originals = known.select("kind", F.col("value").alias("shown"), F.lit(True).alias("original"))
    for _ in range(MAX_ATTEMPTS):
        new = surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("attempt"), secret)
        state = written(state.select("kind", "value", "gender", "attempt", new.alias("new")), "surrogates")
        # names are compared without case, as values are
        state = state.withColumn("shown", F.when(F.col("kind") == "name", F.lower("new")).otherwise(F.col("new")))
        # of values with one surrogate the first stays
        first = state.groupBy("kind", "shown").agg(F.min("value").alias("first"), F.count("*").alias("n")).where("n > 1")
        judged = state.join(first, ["kind", "shown"], "left").join(originals, ["kind", "shown"], "left")
        bad = F.coalesce(F.col("value") != F.col("first"), F.lit(False)) | F.col("original").isNotNull()
        state = written(judged.select("kind", "value", "gender", "attempt", "new", bad.alias("bad")), "surrogates-checked")
        if state.where("bad").isEmpty():
            return state.select("kind", "value", "new")
        state = state.withColumn("attempt", F.col("attempt") + F.col("bad").cast("int"))
    raise ValueError(f"values still share surrogates after {MAX_ATTEMPTS} keys")


def replace(docs: DataFrame, secret: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``: how many values were replaced.

    ``secret`` keys the surrogates: with another one all are different, with the same one they agree between runs, but
    for values that collide in one corpus and not in the other.

    **Defined cases.** A null text stays null, with no entities. Rows are replaced one by one; the same values get the
    same surrogates in all of them. Columns other than ``text`` stay; ``n_entities`` of the input is replaced. An empty
    table gives an empty table.
    """
    docs, named = aside(docs, "doc_id", "text")
    found = docs.select("doc_id", F.explode(_matches(text_of())).alias("m")).select("doc_id", _described(F.col("m")).alias("d"))
    mentions = found.groupBy("doc_id", "d.kind", "d.value").agg(F.min("d.gender").alias("gender"))
    mentions = written(mentions.withColumnRenamed("doc_id", "_doc_id"), "mentions")
    # a name with different titles is one value
    known = written(mentions.groupBy("kind", "value").agg(F.min("gender").alias("gender")), "values")
    each = mentions.join(assigned(known, secret), ["kind", "value"])
    entry = F.struct(F.concat_ws("|", "kind", "value"), "new")
    maps = small(written(each.groupBy("_doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_new")), "surrogates-of-documents"))
    joined = docs.join(maps, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    matched = joined.withColumn("_found", F.when(F.col("_new").isNotNull(), F.transform(_matches(text_of()), _described)))

    def shown(d: Column) -> Column:
        return _in_form(d["kind"], d["spelling"], F.try_element_at(F.col("_new"), F.concat_ws("|", d["kind"], d["value"])))

    between = F.split(text_of(), PATTERN)
    woven = F.array_join(F.zip_with(between, F.transform("_found", shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("_found") > 0, woven).otherwise(F.col("text"))
    n = F.coalesce(F.size("_found"), F.lit(0)).cast("long")
    kept = [text.alias("text") if c == "text" else column for c, column in named.items() if c != "n_entities"]
    return matched.select(*kept, F.greatest(n, F.lit(0)).alias("n_entities"))
