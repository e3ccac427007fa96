"""Private data: detection and keyed surrogates, DataFrame functions only.

``anonymise`` replaces e-mail addresses, phone numbers, payment cards, IBANs, social security
numbers, IPv4 addresses, access keys, assigned secrets, long hex keys and titled personal names.

* **Surrogates** are drawn from a keyed hash of (kind, normal form, attempt): without the key they
  cannot be recomputed. The key is an argument or the setting ``spark.tessera.pii.key``; without
  either it is random for each Spark application. Surrogates keep the kind and format: digits
  stay digits, letters stay in their script (Latin, Cyrillic, Greek) and case, separators stay;
  cards keep their first digit and a valid Luhn digit, IBANs their country and valid check
  digits, phones ``+`` and their country code, e-mail addresses their top-level domain, access
  keys their prefix. Given names follow the gender of the title.
* **Coreference**: one (kind, normal form) has one surrogate in the whole corpus, however it
  is written (``+1 (017) 555-7713``, ``+1-017-555-7713`` and ``(017) 555-7713``); a person's names are
  mapped word by word, so that "Mrs. Ana Smith", "Mrs. Smith" and a later bare "Smith" in the
  same text agree; addresses of one mail domain share a surrogate domain, which is drawn and
  checked like any other entity.
* **Collision checks**: over the table of distinct entities, a draw that another entity also has,
  that was given out before, or that is itself a real value of the corpus is drawn again with the
  next attempt. Different entities keep different surrogates.

Texts without a detection bypass every shuffle. The others are handled by their md5, so copies
are one; their entities are joined with the surrogate table, rendered match by match and put
back between the untouched pieces. A frequent entity makes a hot join key, which AQE splits.

Defined cases: null text stays null with no entities; other columns pass unchanged; repeated rows
get equal texts; bare names are replaced only in texts that also have them behind a title; texts
of any length are read whole; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import free_name, let, quote, stage

#: Titles that announce a name, with the gender they tell (n: none).
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "господин": "m", "Господин": "m", "κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
    "госпожа": "f", "Госпожа": "f", "κυρία": "f", "Dr": "n", "Prof": "n",
}
NAME_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
TITLED = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? {NAME_WORD}(?: {NAME_WORD})*+"

LOCAL = r"[\p{L}\p{M}\p{N}._+-]"
EMAIL = rf"(?<!{LOCAL}){LOCAL}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++"
ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?"
SECRET = rf"(?<![\p{{L}}\p{{N}}]){SECRET_NAME}" + r"(?=[A-Za-z_+/=.-]{0,200}[0-9])[A-Za-z0-9_+/=.-]{8,}+"
HEX = r"(?<![A-Za-z0-9])(?=[a-fA-F]{0,200}[0-9])(?=[0-9]{0,200}[a-fA-F])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"
CARD = r"(?<![\p{L}\p{N}.])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BRACKETED = r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
DASHED = r"(?<![0-9.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
#: Cards in groups; the digits of a card without gaps are more than a phone's group takes.
GROUPED = r"[0-9]{4}(?:(?: [0-9]{4}){2} [0-9]{1,7}|(?:-[0-9]{4}){2}-[0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{5})(?![ -]?[\p{L}\p{N}])"
#: What a phone must not run into with any further group, and with those after the first.
OTHER = f"{IP}|{GROUPED}|{EMAIL}|{HEX}"
GAP = r"[^\p{L}\p{N}\n+]"
SIXTEEN = "[0-9]" + f"{GAP}{{0,6}}[0-9]" * 15
#: At most the 15 digits of E.164; numbers of country code 1 have 11.
PHONE = (
    rf"\+1{GAP}{{0,6}}[0-9]{{3}}{GAP}{{0,6}}[0-9]{{3}}{GAP}{{0,6}}[0-9]{{4}}(?![0-9])"
    rf"|\+[0-9]{{1,3}}{GAP}{{0,6}}[0-9]{{2,4}}{GAP}{{1,6}}(?!{OTHER})[0-9]{{2,4}}(?![0-9])"
    rf"(?:(?!{GAP}{{0,5}}{BRACKETED}){GAP}{{1,6}}(?!{OTHER}|{SSN}|{DASHED})[0-9]{{2,4}}(?![0-9])(?<!{SIXTEEN})){{0,3}}"
    r"|\+[0-9]{8,15}(?![0-9])"
    rf"|{BRACKETED}|{DASHED}"
)
#: Kinds in the order in which a match is told.
KINDS = {"email": EMAIL, "access_key": ACCESS_KEY, "secret": SECRET, "hex_key": HEX, "iban": IBAN, "ip": IP, "card": CARD, "ssn": SSN, "phone": PHONE}
BASE = "|".join(KINDS.values())

LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: (pattern of a script, consonants, vowels, endings by gender) of made-up names.
NAME_SCRIPTS = {
    "cyrillic": (r"\p{IsCyrillic}", "бвгдзклмнпрст", "аеиоу", {"m": "н", "f": "на", "n": "р"}),
    "greek": (r"\p{IsGreek}", "βγδκλμνπρστ", "αεηοι", {"m": "ος", "f": "α", "n": "ης"}),
    "latin": (".", "bcdfgklmnprstv", "aeiou", {"m": "n", "f": "na", "n": "r"}),
}
KEY_SETTING = "spark.tessera.pii.key"
_RANDOM_KEYS: dict[str, str] = {}
ROUNDS = 64
#: FIXED VALUES: country codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = r"^\+[17]", r"^\+(?:20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ENTITY = "struct<part:int,kind:string,norm:string,raw:string>"


def session_key(spark: SparkSession) -> str:
    """The key of the session's settings, or one that is random for the Spark application."""
    return spark.conf.get(KEY_SETTING, None) or _RANDOM_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _title(match: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(match, " "), 1), r"\.$", "")


def _name_words(match: Column) -> Column:
    return let(F.split(match, " "), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))))


def _roles(titled: Column) -> Column:
    """array<struct<word, kind>>: what each name word of the titled mentions is."""
    genders = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])

    def told(m: Column) -> Column:
        def role(ws: Column, given: Column) -> Column:
            return F.transform(ws, lambda w, i: F.struct(F.lower(w).alias("word"), F.when(i < F.size(ws) - 1, given).otherwise("family").alias("kind")))

        given = F.concat(F.lit("given_"), F.coalesce(genders[_title(m)], F.lit("n")))
        return let(given, lambda g: let(_name_words(m), lambda ws: role(ws, g)))

    return F.array_distinct(F.flatten(F.transform(titled, told)))


def _titled(text: Column) -> Column:
    hint = F.lit(False)
    for t in TITLES:
        hint = hint | F.contains(text, F.lit(t + " ")) | F.contains(text, F.lit(t + ". "))
    return F.when(hint, F.regexp_extract_all(text, F.lit(TITLED), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _pattern(roles: Column, titled: Column) -> Column:
    words = F.array_distinct(F.flatten(F.transform(titled, _name_words)))
    bare = F.concat(F.lit(rf"{BASE}|{TITLED}|(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(titled) > 0, bare).otherwise(F.lit(BASE))


def _phone_norm(m: Column) -> Column:
    """The ten digits of a number of country code 1, however written; others with ``+``."""
    national = F.when(m.startswith("+") & (F.length(_digits(m)) == 11) & _digits(m).startswith("1"), F.substring(_digits(m), 2, 10))
    return national.when(m.startswith("+"), F.concat(F.lit("+"), _digits(m))).otherwise(_digits(m))


def _domain(mail: Column) -> Column:
    """A mail address' domain without the last part."""
    return F.regexp_extract(mail, r"@(.*)\.[^.]*$", 1)


def _norm(kind: Column, m: Column) -> Column:
    return (
        F.when(kind.isin("card", "ssn"), _digits(m))
        .when(kind == "phone", _phone_norm(m))
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "hex_key"), F.lower(m))
        .when(kind == "secret", F.regexp_replace(m, f"^{SECRET_NAME}", ""))
        .otherwise(m)
    )


def _entities(match: Column, roles: Column) -> Column:
    """Parts of a match: one, or for names one per word (a title has no kind)."""
    # a phone that ends before another entity may look otherwise without what follows
    kind = F.when(match.startswith("+"), "phone")
    for k, p in reversed(KINDS.items()):
        kind = F.when(match.rlike(f"^(?:{p})$"), k).otherwise(kind)

    def names(m: Column) -> Column:
        def part(w: Column, i: Column, ws: Column) -> Column:
            role = F.element_at(F.filter(roles, lambda r: r["word"] == F.lower(w)), 1)["kind"]
            known = F.when((i == 0) & (F.size(ws) > 1), F.lit(None).cast("string")).otherwise(role)
            return F.struct(i.cast("int").alias("part"), known.alias("kind"), F.lower(w).alias("norm"), w.alias("raw"))

        return let(F.split(m, " "), lambda ws: F.transform(ws, lambda w, i: part(w, i, ws)))

    plain = let(kind, lambda k: F.array(F.struct(F.lit(0).alias("part"), k.alias("kind"), _norm(k, match).alias("norm"), match.alias("raw"))))
    return F.when(kind.isNull(), names(match).cast(f"array<{ENTITY}>")).otherwise(plain.cast(f"array<{ENTITY}>"))


def detect(docs: DataFrame, matches: str, pattern: str, parts: str, text: str = "text") -> DataFrame:
    """Add the pattern of the text's entities, the matches in order, and the parts of each match."""
    t, titled, roles = F.col(quote(text)), free_name([*docs.columns, matches, pattern, parts], "titled"), free_name([*docs.columns, matches, pattern, parts], "roles")
    step = docs.withColumn(titled, _titled(F.coalesce(t, F.lit(""))))
    step = step.withColumn(roles, _roles(F.col(titled))).withColumn(pattern, _pattern(F.col(roles), F.col(titled)))
    found = F.when(t.rlike("[0-9@]") | (F.size(titled) > 0), F.regexp_extract_all(t, F.col(pattern), F.lit(0)))
    step = step.withColumn(matches, F.coalesce(found, F.array().cast("array<string>")))
    # bound here, as the planner may put the roles' expression where the name is, for every word
    return step.withColumn(parts, let(F.col(roles), lambda r: F.transform(matches, lambda m: _entities(m, r)))).drop(titled, roles)


def _pick(alphabet: str, seed: Column, i: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(F.xxhash64(seed, i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))


def _substitute(value: Column, seed: Column, hex_only: Column | None = None) -> Column:
    """Replace every letter and digit by a keyed one of its class; keep the rest."""
    low = LATIN if hex_only is None else None

    def one(c: Column, i: Column) -> Column:
        latin = _pick(LATIN, seed, i) if low else F.when(hex_only, _pick("abcdef", seed, i)).otherwise(_pick(LATIN, seed, i))
        lower = (
            F.when(c.rlike("[0-9]"), _pick("0123456789", seed, i))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, seed, i))
            .when(c.rlike(r"\p{IsGreek}"), _pick(GREEK, seed, i))
            .when(c.rlike(r"[\p{L}\p{M}\p{N}]"), latin)
            .otherwise(c)
        )
        return F.when(c.rlike(r"\p{Lu}"), F.upper(lower)).otherwise(lower)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column, first_doubled: bool) -> Column:
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((i % 2 == 0) == F.lit(first_doubled), twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x)


def _card(norm: Column, seed: Column) -> Column:
    body = F.concat(F.substring(norm, F.lit(1), F.lit(1)), _substitute(F.substring(norm, F.lit(2), F.length(norm) - 2), seed))
    check = F.when(_luhn_sum(norm, False) % 10 == 0, ((10 - _luhn_sum(body, True) % 10) % 10).cast("string")).otherwise(_pick("0123456789", seed, F.lit(-1)))
    return F.concat(body, check)


def _iban(norm: Column, seed: Column) -> Column:
    country, body = F.substring(norm, 1, 2), _substitute(F.substring(norm, F.lit(5), F.length(norm)), seed)

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _ip(seed: Column) -> Column:
    octet = lambda i: F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(256 if i else 223)) + (0 if i else 1)
    return F.concat_ws(".", *[octet(i).cast("string") for i in range(4)])


def _name(norm: Column, seed: Column, kind: Column, attempt: Column) -> Column:
    def syllable(cons: str, vowels: str):
        return lambda i: F.concat(_pick(cons, seed, i * 2), _pick(vowels, seed, i * 2 + 1))

    out = None
    for pattern, cons, vowels, endings in reversed(NAME_SCRIPTS.values()):
        syllables = F.transform(F.sequence(F.lit(0), F.lit(1) + attempt), syllable(cons, vowels))
        stem = F.concat(F.array_join(syllables, ""), _pick(cons, seed, F.lit(-1)), _pick(vowels, seed, F.lit(-2)))
        end = F.when(kind == "given_f", endings["f"]).when(kind == "given_m", endings["m"]).otherwise(endings["n"])
        made = F.concat(stem, end)
        out = made if out is None else F.when(norm.rlike(pattern), made).otherwise(out)
    return out


def surrogate(kind: Column, norm: Column, attempt: Column, domain: Column, key: str) -> Column:
    """The draw number ``attempt`` for an entity, in normal form; ``domain`` is the surrogate of a mail
    address' domain."""

    def of(seed: Column) -> Column:
        longer = F.repeat(F.lit("0"), F.floor(attempt / 8).cast("int"))
        local = F.regexp_extract(norm, "^([^@]*)@", 1)
        email = F.concat(_substitute(F.concat(local, longer), seed), F.lit("@"), domain, F.lit("."), F.substring_index(norm, ".", -1))
        code = F.when(norm.rlike(ONE_DIGIT), 2).when(norm.rlike(TWO_DIGITS), 3).otherwise(4)
        phone = let(code, lambda n: F.concat(F.substring(norm, F.lit(1), n), _substitute(F.concat(F.substring(norm, n + 1, F.length(norm)), longer), seed)))
        return (
            F.when(kind == "email", email)
            .when(kind == "domain", _substitute(F.concat(norm, longer), seed))
            .when(kind == "card", _card(F.concat(norm, longer), seed))
            .when(kind == "iban", _iban(norm, seed))
            .when(kind == "ip", _ip(seed))
            .when(kind == "phone", F.when(norm.startswith("+"), phone).otherwise(_substitute(F.concat(norm, longer), seed)))
            .when(kind == "ssn", _substitute(F.concat(norm, longer), seed))
            .when(kind == "access_key", F.concat(F.substring(norm, 1, 4), _substitute(F.substring(norm, F.lit(5), F.length(norm)), seed)))
            .when(kind == "hex_key", _substitute(F.concat(norm, longer), seed, F.lit(True)))
            .when(kind == "secret", _substitute(F.concat(norm, longer), seed, norm.rlike("^[0-9a-fA-F]+$")))
            .otherwise(_name(norm, seed, kind, attempt))
        )

    return let(F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256), of)


def _render(kind: Column, raw: Column, norm: Column, value: Column) -> Column:
    """Write a surrogate the way the match was written."""

    def spaced(v: Column) -> Column:
        plain = F.regexp_replace(v, r"^\+", "")
        chars = F.transform(
            F.split(raw, ""),
            lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(plain, F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c),
        )
        used = F.length(F.regexp_replace(raw, "[^0-9A-Za-z]", ""))
        return F.concat(F.array_join(chars, ""), F.substring(plain, used + 1, F.length(plain)))

    shouted = (raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1)
    cased = F.when(shouted, F.upper(value)).otherwise(value)
    return (
        F.when(kind.isNull(), raw)
        .when((kind == "phone") & raw.startswith("+") & ~norm.startswith("+"), spaced(F.concat(F.lit("1"), value)))
        .when(kind.isin("card", "ssn", "phone", "iban"), spaced(value))
        .when(kind == "secret", F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(norm)), value))
        .when(kind.isin("email", "hex_key"), cased)
        .when(kind.isin("ip", "access_key"), value)
        .otherwise(F.when(shouted, F.upper(value)).otherwise(F.initcap(value)))
    )


def surrogate_table(entities: DataFrame, key: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(kind, norm, surrogate) for the distinct entities, no surrogate twice within a kind; written.

    ``entities``: a written table of distinct (kind, norm). The domains of mail addresses are entities
    of their own and drawn first."""
    key = key or session_key(entities.sparkSession)
    domains = entities.filter(F.col("kind") == "email").select(F.lit("domain").alias("kind"), _domain(F.col("norm")).alias("norm")).distinct()
    none = F.lit(None).cast("string").alias("domain")
    of = _drawn(stage(domains.select("kind", "norm", none), "pii-domains"), key, rounds)
    mail_domain = F.when(F.col("kind") == "email", _domain(F.col("norm")))
    joined = entities.withColumn("of", mail_domain).join(of.select(F.col("norm").alias("of"), F.col("surrogate").alias("domain")), "of", "left")
    return _drawn(stage(joined.select("kind", "norm", "domain"), "pii-distinct"), key, rounds)


def _drawn(entities: DataFrame, key: str, rounds: int) -> DataFrame:
    """Draws for all (kind, norm, domain) until no two agree and none is a real value; written."""
    given, pending, attempt = None, entities, 0
    reals = entities.select("kind", F.col("norm").alias("value")).withColumn("real", F.lit(True))
    while True:
        draws = pending.withColumn("value", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), F.col("domain"), key))
        first = draws.groupBy("kind", "value").agg(F.min("norm").alias("winner"))
        taken = reals if given is None else reals.unionByName(given.select("kind", F.col("surrogate").alias("value")).withColumn("real", F.lit(False)))
        taken = taken.groupBy("kind", "value").agg(F.count("*").alias("holders"))
        told = stage(
            draws.join(first, ["kind", "value"]).join(taken, ["kind", "value"], "left")
            .select("kind", "norm", "domain", F.col("value").alias("surrogate"), ((F.col("norm") == F.col("winner")) & F.col("holders").isNull()).alias("ok")),
            "pii-draws",
        )
        good = told.filter("ok").select("kind", "norm", "surrogate")
        given = good if given is None else given.unionByName(good)
        pending = told.filter("not ok").select("kind", "norm", "domain")
        attempt += 1
        if pending.isEmpty():
            return stage(given, "pii-surrogates")
        if attempt == rounds:
            raise RuntimeError(f"no free surrogate after {rounds} draws: the corpus fills a kind's format")


def anonymise(docs: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced; ``count`` names a column for their number (one of
    that name gives way). Without ``key`` see :func:`session_key`."""
    columns = docs.columns
    names = {}
    for n in ("matches", "pattern", "parts", "text_key", "rendered"):
        names[n] = free_name([*columns, *names.values(), count or ""], n)
    matches, pattern, parts, tk, rendered = (F.col(names[n]) for n in names)
    found = detect(docs, names["matches"], names["pattern"], names["parts"], text)
    body = F.col(quote(text))
    clean = found.filter(F.size(matches) == 0)
    dirty = found.filter(F.size(matches) > 0).withColumn(names["text_key"], F.md5(body.cast("binary")))

    lists = dirty.select(tk.alias("tk"), parts.alias("parts")).groupBy("tk").agg(F.first("parts").alias("parts"))
    flat = lists.select("tk", F.posexplode("parts").alias("pos", "ps")).select("tk", "pos", F.explode("ps").alias("p")).select("tk", "pos", "p.*")
    flat = stage(flat, "pii-entities")
    table = surrogate_table(stage(flat.filter(F.col("kind").isNotNull()).groupBy("kind", "norm").agg(F.count("*").alias("n")).select("kind", "norm"), "pii-distinct"), key)
    shown = flat.join(table, ["kind", "norm"], "left").select("tk", F.struct("pos", "part", _render(F.col("kind"), F.col("raw"), F.col("norm"), F.col("surrogate")).alias("shown")).alias("s"))
    by_text = stage(shown.groupBy("tk").agg(F.sort_array(F.collect_list("s")).alias("shown")).withColumnRenamed("tk", names["text_key"]).withColumnRenamed("shown", names["rendered"]), "pii-rendered")

    def rebuilt(pieces: Column) -> Column:
        inner = F.transform(rendered, lambda s: F.concat(F.when(s["part"] == 0, F.get(pieces, s["pos"])).otherwise(" "), s["shown"]))
        return F.concat(F.array_join(inner, ""), F.element_at(pieces, -1))

    joined = dirty.join(by_text, names["text_key"])
    replaced = let(F.split(body, pattern, -1), rebuilt)
    extra = [F.size(matches).cast("long").alias(count)] if count else []
    out = [F.col(quote(c)) for c in columns if c != count]
    done = [replaced.alias(text) if c == text else F.col(quote(c)) for c in columns if c != count]
    return clean.select(*out, *extra).unionByName(joined.select(*done, *extra))
