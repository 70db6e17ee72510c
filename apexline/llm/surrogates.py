"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are e-mail addresses, IPv4 and IPv6 addresses, telephone numbers
(international and the usual national forms), card, social-security and bank
account numbers (IBAN), hexadecimal secrets, keys of well-known services, and
names: after a title, and, in the same document, wherever a name that a title
gave away stands without one.

*  A text is searched once.  What is found stays between marks in a kept table,
   from which mentions, entities and the new text all come.
*  An entity's surrogate is a keyed permutation of its form: each letter, digit
   or octet moves within its class (digits, letters of a script, vowels and
   consonants of names, octets of as many digits), by a Feistel network over the
   places, while separators, a country, a domain's ending and a key's prefix stay.
   So entities of a form never collide, the same entity has the same surrogate in
   all documents (coreference), and type, script, case and format are kept.
*  A name is as many entities as it has words, so "Anna Berg" and "Mrs. Berg"
   still share a word.  A given name's surrogate ends as the gender that most of
   its titles tell, in a letter of its own script.  An IBAN gets its right check digits, and so does
   a card number whose check digit is right.  Private, loopback and link-local IPv4 addresses stay
   in their range, and others never get into one.
*  Collision checks run over all distinct entities: a surrogate that is itself an
   entity of the corpus, or that another entity has, is drawn anew with the next
   permutation.  Where a form is over a quarter full, its unused values are listed
   and dealt by rank; where none is left, or ``DRAWS`` draws of a form have failed,
   the form is widened by a character (an IPv4 address becomes any address), so
   that the loop ends with distinct surrogates, whatever their number.

The key is a secret: without it the map can't be rebuilt.  Plans have it as a scalar
subquery over a row of its own, so it isn't in what they print or log.  Only documents with
entities are shuffled; an entity that very many documents share is joined, not
gathered.  Every pattern starts at a word's begin and is bounded, so the time is
linear in a text's length.

Defined results: a null text stays null, an empty one empty; texts without
entities stay as they are; repeated rows get equal texts; columns of the documents
are kept.  More IPv4 addresses than leave a free one in all of IPv4 are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop_kept, fresh, kept

#: Draws of a form before it is widened.
DRAWS = 8
ROUNDS = 8
#: Values of a form that a row lists at once.
CHUNK = 65_536
#: Around what was found; texts that have it themselves have it escaped meanwhile.
MARK, ESCAPE, ONE, TWO = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

#: Titles before names, country codes of bank accounts, prefixes of services' keys.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"),
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr"),
    "-": ("Dr", "Prof", "Professor", "Doctor"),
}
COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
PREFIX = r"gh[pousr]_|AKIA|ASIA|AIza|xox[abprs]-|sk_live_|sk_test_"

_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_NAME = r"\p{Lu}\p{Ll}{1,40}(?:-\p{Lu}\p{Ll}{1,40})?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,20}[A-Za-z]{2,63}",
    "person": rf"(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts}))}])(?<!\p{{L}})(?:(?:{_TITLE})\.? ){{1,3}}{_NAME}(?: {_NAME})?(?!\p{{L}})",
    "token": rf"(?=[agAsx])(?<![0-9A-Za-z_])(?:gh[pousr]_[A-Za-z0-9]{{36,255}}+|(?:AKIA|ASIA)[0-9A-Z]{{16}}|AIza[0-9A-Za-z_-]{{35}}|xox[abprs]-[0-9A-Za-z-]{{10,250}}+|sk_(?:live|test)_[0-9A-Za-z]{{16,250}}+)(?![0-9A-Za-z])",
    "iban": rf"(?=[A-Z]{{2}}\d\d)(?<![0-9A-Za-z])(?:{'|'.join(COUNTRIES)})\d\d(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?(?![0-9A-Za-z])",
    "hex": r"(?=[0-9A-Fa-f]{8})(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![0-9A-Za-z])",
    "ip6": rf"(?=[0-9A-Fa-f]{{1,4}}:)(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "digits": r"(?=[0-9+(])(?:" + "|".join([
        rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
        r"(?<![0-9A-Za-z])\d{3}-\d\d-\d{4}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?![0-9A-Za-z])",
        r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\d+])\+(?=\d(?:[ ().-]{0,2}\d){7,14}(?!\d))\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,14}|(?:[ .-]\d{2,8}){1,6})(?!\d)",
        r"(?<![\d+])0[1-9](?:[ .-]\d\d){4}(?!\d)",
        r"(?<![\d+])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?!\d)",
    ]) + ")",
}
#: Every pattern, and those that a text without "@" needs.
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
NO_EMAIL = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email")
KINDS = [
    ("email", "@"), ("token", rf"^(?:{PREFIX})"), ("iban", r"^[A-Z]{2}\d\d[ 0-9A-Z]+$"), ("hex", r"^[0-9A-Fa-f]{32,128}$"), ("ip6", ":"), ("person", r"^\p{Lu}\p{Ll}"),
    ("ip", rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), ("ssn", r"^\d{3}-\d\d-\d{4}$"), ("card", r"^\d(?:[ -]?\d){12,18}$"),
]

#: Ranges of IPv4 that aren't routed, by what of an address is the range's, and a test for them.
RANGES = r"^(?:10|127)\.|^(?:192\.168|169\.254)\.|^172\.(?=(?:1[6-9]|2\d|3[01])\.)"
#: Endings of given names by gender: in Latin, Cyrillic, Greek and Armenian letters.
ENDINGS = {"f": {"": "a", "Cyrillic": "а", "Greek": "α", "Armenian": "ա"}, "m": {"": "o", "Cyrillic": "о", "Greek": "ο", "Armenian": "ո"}}

#: Letters that move among themselves, by the sign that stands for them in a form.
PLAIN = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
HEX = {"h": "0123456789abcdef"}
NAMES = {
    "v": "aeiou", "k": "bcdfghjklmnpqrstvwxyz", "ä": "àáâãäåæèéêëìíîïòóôõöøùúûüýÿāăąēėęěīįōőœūůűų", "ç": "ßçðñþćčďđğģķĺľłńņňŕřśşšţťźżž",
    "и": "аеёиоуыэюяіїє", "б": "бвгґджзйклмнпрстфхцчшщъьў", "α": "αεηιουωάέήίόύώϊϋ", "β": "βγδζθκλμνξπρστφχψς", "ա": "աեէըիոօ", "բ": "բգդզթժլխծկհձղճմյնշչպջռսվտրցւփքֆ",
}


def let(value: Column, f) -> Column:
    """``f(value)``, with the value worked out once."""
    return F.transform(F.array(value), f)[0]


def _first(cases: list[tuple[Column, Column | str | int]], other):
    """The value of the first case that holds."""
    out = other
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def _kind(m: Column) -> Column:
    """The type of a mention, by what it looks like."""
    return _first([(m.rlike(pattern), F.lit(kind)) for kind, pattern in KINDS], F.lit("phone"))


def _canonical(m: Column, kind: Column) -> Column:
    """What all ways to write an entity have in common."""
    bare = F.regexp_replace(F.lower(m), r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("ip", "token"), m).when(kind.isin("phone", "card", "ssn", "iban"), bare).otherwise(F.lower(m))


def _signs(text: Column, classes: dict[str, str]) -> Column:
    return F.translate(text, "".join(classes.values()), "".join(sign * len(letters) for sign, letters in classes.items()))


def _luhn(digits: Column) -> Column:
    """The check sum of a card number; 0 if its last digit is right."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    places = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: doubled(c.try_cast("int"), i))
    return F.aggregate(places, F.lit(0), lambda total, d: total + d) % 10


def _ending(canon: Column, gender: Column) -> Column:
    """The ending of a name's surrogate, in the script of its first letter."""
    by_script = lambda letters: _first([(canon.rlike(rf"^\p{{Is{script}}}"), F.lit(a)) for script, a in letters.items() if script], F.lit(letters[""]))
    return F.when(gender == "f", by_script(ENDINGS["f"])).when(gender == "m", by_script(ENDINGS["m"])).otherwise("")


def _spelled(entities: DataFrame) -> DataFrame:
    """``entities`` (kind, canon, gender, draw, wide) with ``head``, the fixed part before, ``body``, what moves, ``tail``, the fixed one after; ``form``; and of each place of the body its ``letters``, ``size`` and value ``x``."""
    kind, canon, wide = F.col("kind"), F.col("canon"), F.col("wide")
    head = _first([(kind == "token", F.regexp_extract(canon, rf"^(?:{PREFIX})", 0)), (kind == "iban", F.substring(canon, 1, 2)), (kind == "ip", F.regexp_extract(canon, RANGES, 0)), ((kind == "phone") & canon.startswith("0"), F.lit("0"))], F.lit(""))
    tail = _first([(kind == "email", F.regexp_extract(canon, r"\.[a-z]+$", 0)), (kind.isin("given", "surname"), _ending(canon, F.col("gender")))], F.lit(""))
    checked = (kind == "card") & (_luhn(canon) == 0)
    stop = F.length(canon) - F.when(kind == "email", F.length(tail)).when(checked, 1).otherwise(0)
    start = F.length(head) + F.when(kind == "iban", 2).otherwise(0)
    body = F.substr(canon, start + 1, stop - start)
    more = F.repeat(F.when(kind == "email", "a").when(kind.isin("given", "surname"), "ba").otherwise("0"), wide)
    body = F.when(kind == "ip", F.substr(canon, start + 1)).when(kind.isin("given", "surname"), F.concat(body, more)).otherwise(F.concat(more, body))
    out = entities.withColumns({"head": head, "tail": tail, "checked": checked}).withColumn("body", body)
    # The second octet of 172.16 to 172.31 moves among these.
    octets = F.transform(F.split("body", r"\."), lambda o, i: F.when((F.col("head") == "172.") & (i == 0), "p").when(wide > 0, "0").otherwise(F.length(o).cast("string")))
    signs = F.when(kind.isin("hex", "ip6"), _signs(F.col("body"), HEX)).when(kind.isin("given", "surname"), _signs(F.col("body"), NAMES)).otherwise(_signs(F.col("body"), PLAIN))
    out = out.withColumn("signs", F.when(kind == "ip", F.array_join(octets, ".")).otherwise(signs))
    # A letter of no class moves among a-z; two such words may collide, which the checks find.
    table = F.create_map(*[F.lit(v) for c in (PLAIN, HEX, NAMES) for item in c.items() for v in item])
    name_letter = F.col("kind").isin("given", "surname")
    letters = F.transform(F.split("signs", ""), lambda s: F.coalesce(F.element_at(table, s), F.when(name_letter & s.rlike(r"^\p{L}"), PLAIN["a"])))
    chars = F.split("body", "")
    place = lambda c, a: F.when(a.isNull(), 0).when(F.instr(a, c) > 0, F.instr(a, c) - 1).otherwise(F.pmod(F.ascii(c), F.lit(26)))
    low = lambda s: F.when(s == "p", 16).when(s == "1", 0).when(s == "2", 10).when(s == "3", 100).otherwise(0)
    size = lambda s: F.when(s == "p", 16).when(s == "1", 10).when(s == "2", 90).when(s == "3", 156).otherwise(256)
    is_ip = kind == "ip"
    parts = F.split("signs", r"\.")
    out = out.withColumns({"letters": F.when(~is_ip, letters), "chars": F.when(~is_ip, chars)})
    out = out.withColumns({
        "low": F.when(is_ip, F.transform(parts, low)),
        "size": F.when(is_ip, F.transform(parts, size)).otherwise(F.transform("letters", lambda a: F.coalesce(F.length(a), F.lit(1)))),
        "x": F.when(is_ip, F.zip_with(F.split("body", r"\."), parts, lambda o, s: o.cast("int") - low(s))).otherwise(F.zip_with("chars", "letters", place)),
    })
    return out.withColumn("form", F.concat_ws("|", "kind", "head", "signs", "tail", F.col("wide").cast("string"), F.col("checked").cast("string")))


def _written(x: Column | str) -> Column:
    """The canonical string of places ``x``, from the columns of :func:`_spelled`."""
    x = F.col(x) if isinstance(x, str) else x
    plain = F.array_join(F.transform(x, lambda v, i: F.when(F.get("letters", i).isNull(), F.get("chars", i)).otherwise(F.substr(F.get("letters", i), v + 1, F.lit(1)))), "")
    digits = lambda s: F.regexp_replace(s, "[0-9a-z]", "$0|")
    value = lambda c: F.instr(F.lit(PLAIN["0"] + PLAIN["a"]), c) - 1
    rest = lambda s: F.aggregate(F.filter(F.split(digits(s), r"\|"), lambda c: c != ""), F.lit(0), lambda r, c: (r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    check = let(plain, lambda b: F.concat("head", F.lpad((98 - rest(F.concat(b, "head", F.lit("00")))).cast("string"), 2, "0"), b))
    octets = F.concat("head", F.array_join(F.transform(x, lambda v, i: (v + F.get("low", i)).cast("string")), "."))
    right = let(plain, lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(F.col("kind") == "ip", octets).when(F.col("checked"), right).when(F.col("kind") == "iban", check).otherwise(F.concat("head", plain, "tail"))


def _secret(spark: SparkSession, key: str) -> Column:
    """The key as a subquery over a local table, which no Python worker has to read."""
    row = spark._jsparkSession.createDataset([key], spark._jvm.org.apache.spark.sql.Encoders.STRING()).toDF()
    return DataFrame(row, spark).scalar()


def _permuted() -> Column:
    """Places ``x`` moved by the permutation of the key in column ``secret`` and the entity's form and draw."""

    def step(x: Column, r: Column) -> Column:
        others = F.array_join(F.transform(F.filter(x, lambda v, i: i % 2 != r % 2), lambda v: v.cast("string")), ",")
        digest = F.sha2(F.concat_ws("|", "secret", F.col("form"), F.col("draw").cast("string"), r.cast("string"), others), 256)
        return let(digest, lambda h: F.transform(x, lambda v, i: F.when(i % 2 == r % 2, F.pmod(v + F.xxhash64(h, i), F.get("size", i).cast("long")).cast("int")).otherwise(v)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.col("x"), step)


def _strayed(unrouted: Column) -> Column:
    """Whether a surrogate of an address that isn't ``unrouted`` lies in a range that is."""
    return (F.col("kind") == "ip") & ~unrouted & F.col("surrogate").rlike(RANGES)


def _dealt(asks: DataFrame, entities: DataFrame, taken: DataFrame, secret: Column) -> DataFrame:
    """``asks``, whose draw failed, with whether their form is ``crowded``, and a ``free`` value of it for as many as there are."""
    crowd = _spelled(entities).groupBy("form").agg(F.count("*").alias("n"), F.min_by(F.struct("kind", "canon", "gender", "draw", "wide"), "canon").alias("e"))
    crowd = crowd.join(_spelled(asks).select("form").distinct(), "form", "left_semi").select("form", "n", "e.*")
    crowd = _spelled(crowd.drop("form")).withColumn("space", F.aggregate("size", F.lit(1.0), lambda p, x: p * x)).where("space <= 4.0 * n").withColumn("space", F.col("space").cast("long"))
    below = F.transform("size", lambda x, i: F.aggregate(F.slice("size", F.lit(1), i), F.lit(1).cast("long"), lambda p, y: p * y))
    crowd = kept(crowd.withColumn("below", below), "crowded")
    chunks = crowd.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(space - 1) div {CHUNK}")))).repartition("form", "chunk")
    values = chunks.withColumn("v", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("space"), (F.col("chunk") + 1) * CHUNK) - 1)))
    values = values.withColumn("x", F.expr("zip_with(size, below, (s, b) -> cast((v div b) % s as int))")).select("form", "kind", _written("x").alias("surrogate"))
    values = values.where(~_strayed(F.get(F.split("form", r"\|"), 1) != ""))
    rank = lambda df, by: df.withColumn("secret", secret).withColumn("rank", F.row_number().over(Window.partitionBy("form").orderBy(F.xxhash64("secret", by), by))).drop("secret")
    free = rank(values.join(taken, ["kind", "surrogate"], "left_anti"), "surrogate").select("form", "rank", F.col("surrogate").alias("free"))
    asked = _spelled(asks).select(*asks.columns, "form").join(crowd.select("form", F.lit(True).alias("crowded")), "form", "left")
    return rank(asked, "canon").join(free, ["form", "rank"], "left").select(*asks.columns, F.coalesce("crowded", F.lit(False)).alias("crowded"), "free")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, gender, surrogate) of distinct (kind, canon) with a gender, after collision checks; kept tables."""
    columns = ["kind", "canon", "gender", "surrogate"]
    entities = kept(entities.select("kind", "canon", "gender").withColumns({"draw": F.lit(0), "wide": F.lit(0)}), "entities")
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    open_, settled = entities.withColumn("free", F.lit(None).cast("string")), None
    turn, secret = 0, _secret(entities.sparkSession, key)
    while True:
        drawn = _spelled(open_).withColumn("secret", secret).withColumn("surrogate", F.coalesce("free", _written(_permuted()))).select("kind", "canon", "gender", "draw", "wide", "surrogate")
        drawn = kept(drawn, "drawn")
        taken = real if settled is None else real.unionByName(settled.select("kind", "surrogate"))
        one = drawn.where(~_strayed(F.col("canon").rlike(RANGES))).groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = one.join(taken, ["kind", "surrogate"], "left_anti").withColumn("good", F.lit(True))
        judged = kept(drawn.join(good, ["kind", "surrogate", "canon"], "left"), "judged")
        drop_kept(drawn)
        fine = judged.where("good").select(columns)
        settled = fine if settled is None else settled.unionByName(fine)
        asks = judged.where("good is null").select("kind", "canon", "gender", "draw", "wide")
        if asks.isEmpty():
            return settled
        if turn == 0:
            asks = kept(_dealt(asks, entities, taken.unionByName(fine.select("kind", "surrogate")), secret), "dealt")
            widened = F.col("crowded") & F.col("free").isNull()
        else:
            asks = asks.withColumn("free", F.lit(None).cast("string"))
            widened = (F.col("draw") + 1) % DRAWS == 0
        if turn > 20 * DRAWS and not asks.where("kind = 'ip'").isEmpty():
            raise ValueError("no IPv4 address is left for a surrogate")
        open_ = asks.withColumns({"draw": F.col("draw") + 1, "wide": F.col("wide") + F.when(widened, 1).otherwise(0)}).select("kind", "canon", "gender", "draw", "wide", "free")
        turn += 1


def _render(m: Column, kind: Column, canon: Column, surrogate: Column) -> Column:
    """The surrogate, written as the mention is."""
    alike = F.when(kind.isin("email", "hex", "ip6", "given", "surname"), F.length(m)).otherwise(0)
    more = F.when(kind.isin("given", "surname"), 0).otherwise(F.greatest(F.length(surrogate) - F.length(canon), F.lit(0)))
    cased = lambda c, new: F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
    straight = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(alike, F.lit(1))), lambda i: cased(F.substr(m, i, F.lit(1)), F.substr(surrogate, more + i, F.lit(1)))), "")
    straight = F.concat(F.substr(surrogate, F.lit(1), more), straight, F.substr(surrogate, more + alike + 1))
    before = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.length(m), F.lit(64))), lambda i: let(F.substr(m, i, F.lit(1)), lambda c: F.when(~c.rlike(r"[\p{L}\p{N}]"), c).otherwise(cased(c, F.substr(surrogate, more + before(i), F.lit(1)))))), "")
    return F.when(kind.isin("ip", "token"), surrogate).when(alike > 0, straight).otherwise(F.concat(F.substr(surrogate, F.lit(1), more), spaced))


def _bits(text: Column) -> Column:
    """Of a text with entities, an array of (glue, m, kind, gender): each entity's word or number after what stands before it; last, with null, the rest. Null without any."""
    clean = F.when(text.rlike(f"[{MARK}{ESCAPE}]"), F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + TWO)), F.lit(MARK), F.lit(ESCAPE + ONE))).otherwise(text)
    marked = let(clean, lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, ENTITY, f"{MARK}$0{MARK}")).otherwise(F.regexp_replace(t, NO_EMAIL, f"{MARK}$0{MARK}")))
    title = rf"^(?:(?:{_TITLE})\.? )+"
    female, male = (rf"^(?:(?:{_TITLE})\.? )*?(?:{'|'.join(TITLES[g])})\.? " for g in "fm")

    def named(t: Column) -> Column:
        """Names that a title gave away are marked where they stand alone, too."""
        names = F.transform(F.regexp_extract_all(t, F.lit(rf"{MARK}(?:(?:{_TITLE})\.? )+([^{MARK}]+){MARK}"), F.lit(1)), lambda n: n)
        every = F.array_distinct(F.concat(names, F.transform(names, lambda n: F.regexp_extract(n, r"\S+$", 0))))
        longest = F.array_sort(every, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
        pattern = F.concat(F.lit(rf"{MARK}([^{MARK}]*){MARK}|(?<![\p{{L}}])("), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))
        return F.when(t.rlike(rf"{MARK}(?:{_TITLE})\.? "), F.regexp_replace(t, pattern, F.lit(f"{MARK}$1$2{MARK}"))).otherwise(t)

    back = lambda s: F.when(F.contains(s, F.lit(ESCAPE)), F.replace(F.replace(s, F.lit(ESCAPE + ONE), F.lit(MARK)), F.lit(ESCAPE + TWO), F.lit(ESCAPE))).otherwise(s)
    bit = lambda glue, m, kind, gender: F.struct(glue.alias("glue"), m.alias("m"), kind.alias("kind"), gender.alias("gender"))
    none = F.lit(None).cast("string")

    def one(glue: Column, m: Column) -> Column:
        kind = F.when(m.rlike(title), "person").otherwise(_kind(m))
        called, names = F.regexp_extract(m, title, 0), F.split(F.regexp_replace(m, title, ""), " ")
        gender = F.when(m.rlike(female), "f").when(m.rlike(male), "m").otherwise("-")
        last = F.size(names) - 1
        person = F.transform(names, lambda n, i: bit(F.when(i == 0, F.concat(glue, called)).otherwise(" "), n, F.when(i == last, "surname").otherwise("given"), gender))
        return F.when(kind == "person", person).otherwise(F.array(bit(glue, m, kind, F.lit("-"))))

    def cut(pieces: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(2)), lambda i: F.when(i + 1 < F.size(pieces), one(back(F.get(pieces, i)), F.get(pieces, i + 1))).otherwise(F.array(bit(back(F.get(pieces, i)), none, none, none))))
        return F.flatten(pairs)

    return let(marked, lambda t: F.when(F.contains(t, F.lit(MARK)), let(F.split(named(t), MARK), cut)))


def replace(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> tuple[DataFrame, str]:
    """``docs`` with surrogates in ``text`` and the number of entities in a column (its name is the second result). ``key`` is a secret."""
    if not key:
        raise ValueError("surrogates need a secret key")
    count = fresh(docs, count)
    bits, row = fresh(docs, "bits"), fresh(docs, "row")
    # Written once: the patterns run once, and a row's number stays what it is.
    found = docs.withColumn(bits, _bits(F.col(text))).withColumn(row, F.monotonically_increasing_id()).withColumn(text, F.when(F.col(bits).isNull(), F.col(text)))
    found = kept(found, "found")
    hit = found.where(F.col(bits).isNotNull())
    mentions = hit.select(F.col(row).alias("row"), F.posexplode(bits).alias("at", "b")).select("row", "at", "b.*").where("m is not null")
    mentions = mentions.withColumn("canon", _canonical(F.col("m"), F.col("kind")))
    told = F.sum(F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", -1).otherwise(0))
    entities = mentions.groupBy("kind", "canon").agg(F.when(F.col("kind") != "given", "-").when(told > 0, "f").when(told < 0, "m").otherwise("-").alias("gender"))
    table = assign(entities, key)
    new = mentions.join(table.select("kind", "canon", "surrogate"), ["kind", "canon"])
    new = new.select("row", "at", _render(F.col("m"), F.col("kind"), F.col("canon"), F.col("surrogate")).alias("new"))
    with_ = fresh(docs, "new")
    new = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "new")))["new"].alias(with_)).withColumnRenamed("row", row)
    whole = F.array_join(F.transform(bits, lambda b, i: F.concat(b["glue"], F.coalesce(F.get(with_, i), F.lit("")))), "")
    changed = hit.join(new, row).select(*[whole.alias(c) if c == text else F.col(c) for c in docs.columns], F.size(with_).cast("long").alias(count))
    return found.where(F.col(bits).isNull()).select(*docs.columns, F.lit(0).cast("long").alias(count)).unionByName(changed), count


def report(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: its text with surrogates, and how many entities (words of names each) were replaced."""
    found, count = replace(docs.select("doc_id", "text"), key)
    return found.select("doc_id", F.col(count).alias("n_entities"), "text")
