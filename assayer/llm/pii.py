"""Personal data: detected entities get keyed surrogates of their type, script, gender and format.

The surrogate of an entity is a keyed digest of its type and canonical value, so it is the same in every document.  Over
all distinct entities, surrogates that two entities share, or that equal a value of the corpus, are drawn again until
none is left.  Everything is DataFrame operations; texts without entities are neither joined nor shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.joins import once
from assayer.session import written

_MALE = "Mr|Herrn?|Monsieur|Señor|Господин|Signor"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Госпожа|Signora|Signorina"
_TITLE = f"(?:(?:{_MALE}|{_FEMALE}|Sra?|Dr|Prof)\\.?)"
#: A genitive 's is no part of a name.
_INNER = "(?:['’\\-](?!s(?!\\p{L}))\\p{L}++)"
_NAME = f"\\p{{Lu}}(?:\\p{{L}}++{_INNER}*+|{_INNER}++)"
#: Names of secrets, in any case and behind any prefix (db_password, accessToken); the prefix stays.
_KEY = "(?i:password|passwd|pwd|token|secret|api_?key)"
#: A value that repeats one sign, such as ********, hides its secret already.
_NO_MASK = "(?![\"']?(?<sign>[^\\p{L}\\p{N}\\s\"',;])\\k<sign>*+[.!?)\\]]*+(?:[\\s\"',;]|$))"
_HOST = "(?:[\\p{L}\\p{N}\\-]+\\.)+\\p{L}{2,}"

#: Type and pattern, in the order in which they are tried at a place.  Each begins where no longer token runs, so no
#: pattern is tried again within a run of its own characters.
PATTERNS = (
    ("email", f"(?<![\\p{{L}}\\p{{N}}._%+\\-])[\\p{{L}}\\p{{N}}._%+\\-]{{1,64}}@{_HOST}"),
    ("secret", "(?:(?<![A-Za-z0-9_\\-])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_\\-]{20,}+)"
               f"|{_KEY}\\s{{0,3}}[=:]\\s{{0,3}}{_NO_MASK}(?:\"[^\"\\s]{{6,}}+\"|'[^'\\s]{{6,}}+'|[^\\s\"',;]{{6,}}+))"),
    ("iban", "(?<![\\p{L}\\p{N}])[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}\\p{N}])"),
    ("card", "(?<![\\p{L}\\p{N}.+\\-])(?:\\d{4}[ \\-]?){3}\\d{1,7}(?![\\p{L}\\p{N}]|[.\\-]\\d)"),
    ("phone", "(?<![\\p{L}\\p{N}])(?:\\+\\d{1,3}[ .\\-]?\\(\\d{1,4}\\)[ .\\-]?\\d{2,5}(?:[.\\-]?\\d{2,5}){0,3}"
              "|\\+\\d{1,3}(?:(?: \\d{2,5}){2,5}|(?:\\.\\d{2,5}){2,5}|(?:-\\d{2,5}){2,5})|\\+\\d{7,15}"
              "|\\(\\d{3}\\) ?\\d{3}[ .\\-]\\d{4}|\\d{3}[ .\\-]\\d{3}[ .\\-]\\d{4}|0\\d{2,4}[ /\\-]\\d{5,8}(?![.\\-]\\d))(?!\\p{N})"),
    ("ssn", "(?<![\\p{L}\\p{N}\\-])\\d{3}-\\d{2}-\\d{4}(?![\\p{L}\\p{N}\\-])"),
    ("ip", "(?<![\\p{L}\\p{N}.])(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?![\\p{L}\\p{N}]|\\.\\d)"),
    ("ip6", "(?<![\\p{L}\\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![\\p{L}\\p{N}:])"),
    ("person", f"(?<!\\p{{L}}){_TITLE} {_NAME}(?: (?!{_TITLE} ){_NAME})*+"),
)
ANY = "|".join(p for _, p in PATTERNS)
#: What every entity holds; texts without it are not searched.
HINT = f"[@0-9]|(?i:pass|pwd|token|secret|key)|AKIA|gh[pousr]_|sk-|{_TITLE} \\p{{Lu}}"
#: A word that is a name if the text has a person of that name.
BARE = f"(?<![\\p{{L}}]){_NAME}"
PARTS = "array<struct<kind:string,canon:string>>"


def found(text: Column) -> Column:
    """Entities of a text as they stand, in order; an empty array for null."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none), none)


def kind_of(entity: Column) -> Column:
    """The first type whose pattern fits the whole entity."""
    tests = [F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS]
    return F.coalesce(*tests, F.lit("secret"))


def _plain(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9A-Za-z]", "")


def parts_of(kind: Column, entity: Column) -> Column:
    """Canonical parts that get a surrogate: one for most types; a person's given names and last name are parts of their
    own, with the gender of the title, so that a mention by last name alone is replaced alike."""
    one = lambda k, c: F.array(F.struct(k.alias("kind"), c.alias("canon")))
    words = F.split(entity, " ")
    gender = F.when(words[0].rlike(f"^(?:{_MALE}|Sr)\\.?$"), "m").when(words[0].rlike(f"^(?:{_FEMALE}|Sra)\\.?$"), "f").otherwise("n")
    names = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.struct(
        F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender)).alias("kind"),
        F.lower(F.get(words, i)).alias("canon")))
    return (F.when(kind == "person", names)
            .when(kind == "email", one(kind, F.lower(entity)))
            .when(kind.isin("secret", "ip"), one(kind, entity))
            .when(kind == "ip6", one(kind, F.lower(entity)))
            .when((kind == "phone") & entity.startswith("+"), one(kind, F.concat(F.lit("+"), _plain(entity))))
            .otherwise(one(kind, F.upper(_plain(entity)))))


def _draw(key: str, i: Column, size: int) -> Column:
    """A number below size from the keyed digest of the entity, the attempt and a position."""
    seed = F.concat_ws("|", F.lit(key), F.col("kind"), F.col("canon"), F.col("attempt").cast("string"), i.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 12), 16, 10).cast("long"), F.lit(size)).cast("int")


def _pick(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), at + 1, F.lit(1))


_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _like(key: str, char: Column, i: Column) -> Column:
    """A character of the same script, case and kind."""
    low = F.lower(char)
    drawn = (F.when(char.rlike("\\p{N}"), _pick("0123456789", _draw(key, i, 10)))
             .when(low.rlike("\\p{IsCyrillic}"), _pick(_CYRILLIC, _draw(key, i, len(_CYRILLIC))))
             .when(low.rlike("\\p{IsGreek}"), _pick(_GREEK, _draw(key, i, len(_GREEK))))
             .when(low.rlike("\\p{L}"), _pick(_LATIN, _draw(key, i, 26))).otherwise(char))
    return F.when(char.rlike("\\p{Lu}"), F.upper(drawn)).otherwise(drawn)


def _spelled(key: str, text: Column, keep: Column) -> Column:
    """Every character drawn anew from a position on."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(i < keep, c).otherwise(_like(key, c, i))), "")


def _check_digit(digits: Column) -> Column:
    """The digit that makes a number valid whose other digits are these (the rule of payment cards)."""
    own = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(10 - F.aggregate(own, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("string")


def _syllables(key: str, ends: dict[str, tuple[str, str, str]]) -> Column:
    """A name of two or three syllables, more with each attempt, in the script of the entity."""
    def name(consonants: str, vowels: str, tail: Column) -> Column:
        n = F.least(2 + _draw(key, F.lit(90), 2) + F.col("attempt"), F.lit(8))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
            _pick(consonants, _draw(key, i, len(consonants))), _pick(vowels, _draw(key, i + 40, len(vowels))))), ""), tail)

    def tail(script: int) -> Column:
        return reduce(lambda c, k: c.when(F.col("kind") == k, ends[k][script]), list(ends)[1:], F.when(F.col("kind") == list(ends)[0], ends[list(ends)[0]][script]))

    return (F.when(F.col("canon").rlike("\\p{IsCyrillic}"), name("бвгдзклмнпрст", "аеио", tail(1)))
            .when(F.col("canon").rlike("\\p{IsGreek}"), name("βγδκλμνπρστ", "αειο", tail(2)))
            .otherwise(name("bdfgklmnprstv", "aeiou", tail(0))))


#: Endings by part: Latin, Cyrillic, Greek script.  They carry the gender.
ENDINGS = {"given_m": ("ro", "слав", "ος"), "given_f": ("na", "на", "να"), "given_n": ("l", "ль", "λ"), "surname": ("rn", "рн", "ρν")}


def surrogate(key: str) -> Column:
    """Canonical surrogate of (kind, canon, attempt)."""
    canon, kind = F.col("canon"), F.col("kind")
    zone = F.regexp_extract(canon, "\\.\\p{L}+$", 0)  # the last label of a mail host stays
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(key, i, 254) + 1).cast("string")), ".")
    digits = _spelled(key, canon, F.lit(1))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = _check_digit(F.substring(canon, F.lit(1), F.length(canon) - 1)) == F.substring(canon, -1, 1)
    head = F.regexp_extract(canon, f"^(?:AKIA|gh[pousr]_|sk-|{_KEY}\\s*[=:]\\s*)", 0)
    value = F.substring(canon, F.length(head) + 1, F.length(canon))
    hexed = F.concat(head, F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", _draw(key, i, 16))).otherwise(c)), ""))
    country = F.when(canon.startswith("+1") | canon.startswith("+7"), 2).when(canon.startswith("+"), 3).otherwise(0)
    # values with nothing, or too little, to draw anew would clash for ever: from the third attempt on they grow by letters
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("attempt") - 1, F.lit(1))), lambda i: _pick(_LATIN, _draw(key, i + 1000, 26))), "")
    more = F.when(F.col("attempt") > 1, more).otherwise("")
    opened = F.length(F.regexp_extract(canon, f"^(?:AKIA|gh[pousr]_|sk-|{_KEY}\\s*[=:]\\s*[\"']?)", 0))
    grown = lambda fake: F.concat(F.substring(fake, F.lit(1), opened), more, F.substring(fake, opened + 1, F.length(fake)))
    return (F.when(kind.startswith("given_") | (kind == "surname"), _syllables(key, ENDINGS))
            .when(kind == "email", F.concat(more, _spelled(key, F.substring(canon, F.lit(1), F.length(canon) - F.length(zone)), F.lit(0)), zone))
            .when(kind == "ip", octets)
            .when(kind == "ip6", F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", _draw(key, i, 16))).otherwise(c)), ""))
            .when((kind == "card") & valid, F.concat(body, _check_digit(body)))
            .when(kind == "card", digits)
            .when(kind == "iban", _spelled(key, canon, F.lit(2)))
            .when((kind == "secret") & value.rlike("^[\"']?[0-9a-f]+[\"']?$"), grown(hexed))
            .when(kind == "secret", grown(_spelled(key, canon, F.length(head))))
            .otherwise(_spelled(key, canon, country)))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, fake) for distinct entities (kind, canon): no two of a kind share a fake, and none is a value of the
    corpus.  Each round keeps the smallest entity of every clash and draws the others anew; a written table each."""
    entities = written(entities.distinct(), "pii-entities")
    # people's parts must not clash with each other's, whatever their kind: compare within the family of a kind
    family = F.when(F.col("kind").rlike("^given_|^surname$"), "person").otherwise(F.col("kind"))
    taken = entities.select(family.alias("family"), F.col("canon").alias("fake")).distinct()
    waiting, done, attempt = entities.withColumn("attempt", F.lit(0)), None, 0
    while True:
        drawn = waiting.withColumn("fake", surrogate(key)).withColumn("family", family)
        free = drawn.join(taken, ["family", "fake"], "left_anti")
        if done is not None:
            free = free.join(done.select("family", "fake"), ["family", "fake"], "left_anti")
        won = free.groupBy("family", "fake").agg(F.min(F.struct("kind", "canon")).alias("who")).select("family", "fake", "who.kind", "who.canon")
        won = written(won, "pii-won")
        done = won if done is None else done.unionAll(won)
        waiting = written(waiting.join(won, ["kind", "canon"], "left_anti").withColumn("attempt", F.lit(attempt + 1)), "pii-waiting")
        attempt += 1
        if waiting.isEmpty():
            return done.select("kind", "canon", "fake")


def _name_of(part: Column) -> Column:
    return F.concat_ws("\u0001", part["kind"], part["canon"])


def _filled(entity: Column, fake: Column) -> Column:
    """A fake's letters and digits in the entity's own punctuation."""
    fake = F.regexp_replace(fake, "^\\+", "")
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(
        c.rlike("[0-9A-Za-z]"), F.substring(fake, F.length(_plain(F.substring(entity, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _rebuilt(kind: Column, entity: Column, parts: Column, fakes: Column) -> Column:
    fake = lambda part: F.get(F.map_values(F.map_filter(fakes, lambda k, _: k == _name_of(part))), F.lit(0))
    first = fake(F.get(parts, F.lit(0)))
    words = F.split(entity, " ")
    cased = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("\\p{Lu}"), F.upper(F.substring(first, i + 1, F.lit(1)))).otherwise(F.substring(first, i + 1, F.lit(1)))), "")
    return (F.when(kind == "person", F.concat_ws(" ", words[0], F.transform(parts, lambda p: F.initcap(fake(p)))))
            .when(kind == "email", F.when(F.length(first) == F.length(entity), cased).otherwise(first))
            .when(kind.isin("ip", "ip6", "secret"), first)
            .otherwise(_filled(entity, first)))


def _respelled(piece: Column, names: Column) -> Column:
    """A piece of text between entities with its words that are names of the text's own persons replaced."""
    def fake(word: Column) -> Column:
        new = F.element_at(names, F.lower(word))
        return F.coalesce(F.when(word == F.upper(word), F.upper(new)).otherwise(F.initcap(new)), word)

    gaps = F.split(piece, BARE, -1)
    words = F.regexp_extract_all(piece, F.lit(BARE), F.lit(0))
    new = F.concat(F.array_join(F.transform(words, lambda w, i: F.concat(F.get(gaps, i), fake(w))), ""), F.element_at(gaps, -1))
    return F.when(names.isNull(), piece).otherwise(new)


def _bare(pieces: Column, names: Column) -> Column:
    """Number of words in these pieces that are replaced as names of the text's own persons."""
    own = lambda p: F.size(F.filter(F.regexp_extract_all(p, F.lit(BARE), F.lit(0)), lambda w: F.map_contains_key(names, F.lower(w))))
    return F.when(names.isNull(), 0).otherwise(F.aggregate(pieces, F.lit(0), lambda n, p: n + own(p)))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col's entities replaced, and n_entities, how many were.

    Names of a person found in a text are replaced wherever they stand in that text, with or without the title.
    Equal entities get equal surrogates in all documents, different ones different.  Null and empty texts, and texts
    without entities, stay as they are, with n_entities 0; texts of any length are searched whole.  Where patterns tie at a
    place, the first of PATTERNS wins.  Rows are neither dropped nor joined by an id, so ids may be null or repeat; columns
    of any other name are carried through, a column n_entities is replaced.

    Each text is searched once: the rows and what was found in them are written, and every later step reads that.
    """
    names = [c for c in docs.columns if c.lower() != "n_entities"]
    text = F.col(f"`{text_col}`").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]) if len(names) > 1 else F.lit(None).cast("string")
    hits = once(docs.select(row.alias("row"), text.alias("text")), found=found(F.col("text")))
    hits = written(hits.withColumn("key", F.when(F.size("found") > 0, F.sha2(F.col("text").cast("binary"), 256))), "pii-rows")
    back = lambda text, n: [*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names], n.cast("long").alias("n_entities")]
    clean = hits.where("key is null").select(*back(F.col("text"), F.lit(0)))
    hits = hits.where("key is not null")

    texts = hits.select("key", F.explode(F.array_distinct("found")).alias("entity")).distinct()
    texts = texts.withColumn("kind", kind_of(F.col("entity"))).withColumn("parts", parts_of(F.col("kind"), F.col("entity")))
    texts = written(texts, "pii-found")
    mentioned = texts.select("key", "entity", "kind", "parts", F.explode("parts").alias("part"))
    fakes = surrogates(mentioned.select("part.kind", "part.canon"), key)
    # a value's surrogate is the same everywhere, so each distinct entity is rebuilt once, then handed to its texts
    spelled = texts.select("entity", "kind", "parts").distinct()
    looked = spelled.select("entity", F.explode("parts").alias("part")).select("entity", "part", F.col("part.kind").alias("kind"), F.col("part.canon").alias("canon"))
    looked = looked.join(fakes, ["kind", "canon"]).groupBy("entity").agg(F.map_from_entries(F.collect_set(F.struct(_name_of(F.col("part")), "fake"))).alias("fakes"))
    rebuilt = spelled.join(looked, "entity").select("entity", _rebuilt(F.col("kind"), F.col("entity"), F.col("parts"), F.col("fakes")).alias("fake"))
    per_text = texts.select("key", "entity").join(rebuilt, "entity").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("entity", "fake"))).alias("fakes"))
    # a bare word that is both a given name and a surname of the text's persons counts as the given name
    people = mentioned.where("kind = 'person'").select("key", F.col("part.kind").alias("kind"), F.col("part.canon").alias("canon")).distinct()
    people = people.join(fakes, ["kind", "canon"]).groupBy("key", "canon").agg(F.min_by("fake", "kind").alias("fake"))
    people = people.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("canon", "fake"))).alias("people"))
    between = F.split(F.col("text"), ANY, -1)
    own = F.col("people")
    whole = F.concat(F.array_join(F.transform("found", lambda e, i: F.concat(_respelled(F.get(between, i), own), F.element_at("fakes", e))), ""),
                     _respelled(F.element_at(between, -1), own))
    changed = hits.join(per_text.join(people, "key", "left"), "key").select("row", F.struct(whole.alias("text"), (F.size("found") + _bare(between, own)).alias("n")).alias("new"))
    return clean.unionAll(changed.select(*back(F.col("new.text"), F.col("new.n"))))
