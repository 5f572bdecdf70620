r"""Surrogates for personal data: keyed, type-consistent, distinct, coherent.

Entities are found by one pattern: e-mail addresses, IPv4 addresses, phone and
card numbers, secrets after a name such as ``token =``, and names after a title.
All steps are DataFrame expressions, joins and aggregations.

* An entity's *canon* is what its spellings have in common (lower case, digits
  without separators, phones without country code and leading zeros). Surname
  and given names of a person are entities of their own, without title. The
  surrogate belongs to the canon, so one person's number and surname get one
  replacement in every document and format: coreference.
* The surrogate comes from a hash of key, type, canon and attempt, and keeps
  the type: addresses stay addresses, digits take the separators of the
  original, letters keep case and script, given names end by their title.
* Collision check: distinct canons are counted by surrogate over the corpus;
  of those that meet, and of those that equal a real entity, all but the first
  draw again, until every surrogate is one canon's: distinctness.

Texts are split at the matches and put together again with the surrogates.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingflow.functions.lineage import cut

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
_EMAIL = r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]++@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.){1,126}\p{L}{2,63}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?|\+[0-9]{1,3}[ .-]?|\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"
_CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NAMED = r"(?i:token|secret|password|passwd|apikey|api_key|api-key|access_key)[\"']?\s?[=:]\s?[\"']?"
_KEY = r"AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|[0-9a-f]{32,}+|[0-9A-F]{32,}+"
_SECRET = rf"{_NAMED}(?=[A-Za-z0-9_+/=.-]{{8}})[A-Za-z0-9_+/=-]++(?:\.[A-Za-z0-9_+/=-]++)*+|(?<![A-Za-z0-9])(?:{_KEY})(?![A-Za-z0-9])"
_WORD = r"\p{Lu}(?:[\p{L}'-]++|\.)"  # or an initial
_PERSON = rf"(?<![\p{{L}}])(?:{'|'.join((*FEMALE, *MALE))})\.? (?:\p{{Lu}}\. )*+\p{{Lu}}[\p{{L}}'-]++(?: {_WORD})*+"
PATTERN = "|".join((_EMAIL, _SECRET, _IP, _SSN, _CARD, _PHONE, _PERSON))
#: What a text must have to hold an entity: cheap to look for in the others.
_HINT = r"[0-9@=:]|AKIA|gh[pousr]_|sk-|[a-f]{32}|[A-F]{32}|[MHFSГΚ](?:rs?|s|iss|err|rau|onsieur|adame|me|e[ñn]ora?|ra|осп|ύρι|υρί)[.\p{L}]* "
_FULL = {"email": _EMAIL, "ip": _IP, "ssn": _SSN, "card": _CARD, "phone": _PHONE, "person": _PERSON}

#: Syllables of generated names by script; a name has a keyed row of them.
_SYLLABLES = {
    "Latin": "ba da fe ga ka la ma na pa ra sa ta vi za lo mi no re so tu".split(),
    "Cyrillic": "ба да ве га ка ла ма на па ра са та ви за ло ми но ре со ту".split(),
    "Greek": "βα δα φε γα κα λα μα να πα ρα σα τα βι ζα λο μι νο ρε σο τυ".split(),
}
_ENDING = {"Latin": ("an", "ina"), "Cyrillic": ("ан", "ина"), "Greek": ("ος", "ίνα")}


def kind(raw: Column) -> Column:
    """The type of a match; the patterns are tried in the order of the union."""
    out = F.when(raw.rlike(rf"^(?:{_EMAIL})$"), "email")
    for name in ("ip", "ssn", "card", "phone", "person"):
        out = out.when(raw.rlike(rf"^(?:{_FULL[name]})$"), name)
    return out.otherwise("secret")


#: Country codes: of one and two digits, else of three.
_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _national(raw: Column) -> Column:
    """The digits of a phone without country code and leading zeros.

    Only the digits decide, not how they are grouped. What would be left with
    under four digits keeps all.
    """
    digits = F.regexp_replace(raw, "[^0-9]", "")
    short = F.regexp_replace(F.when(raw.startswith("+"), F.regexp_replace(digits, _CODE, "")).otherwise(digits), "^0+", "")
    return F.when(F.length(short) < 4, digits).otherwise(short)


def canon(raw: Column, what: Column) -> Column:
    """What all spellings of an entity share; of a person, of one of its names."""
    name = F.regexp_replace(F.lower(raw), r"(?:'s?|\.)$", "")
    return F.when(what.isin("ssn", "card"), F.regexp_replace(raw, "[^0-9]", "")).when(what == "phone", _national(raw)).when(what == "email", F.lower(raw)).when(what == "secret", F.regexp_replace(raw, f"^{_NAMED}", "")).otherwise(F.when(what.isin("given", "surname"), name).otherwise(raw))


def parts(raw: Column, what: Column) -> Column:
    """The entities of a match, in order: an array of (kind, raw).

    A person is its names without the title, the last of them the surname.
    """
    words = F.split(raw, " ")
    names = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.struct(F.when(i == F.size(words) - 2, "surname").otherwise("given").alias("kind"), w.alias("raw")))
    return F.when(what == "person", names).otherwise(F.array(F.struct(what.alias("kind"), raw.alias("raw"))))


def _digits(canon_: Column, seed: Column, n: int = 128) -> Column:
    """n hex digits that only the key, the canon and the attempt decide."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", seed, canon_, F.lit(str(i))), 256) for i in range(n // 64)))


def _number(hexes: Column, at: int, digits: int = 8) -> Column:
    return F.conv(F.substring(hexes, at, digits), 16, 10).cast("long")


def _like(raw: Column, hexes: Column) -> Column:
    """raw with every letter and digit replaced by one of its class.

    Each place takes its own byte of the hash; ASCII letters stay in case,
    other letters become letters of their own script.
    """
    each = lambda i: F.conv(F.substring(hexes, F.pmod(i * 2, F.lit(126)).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, i: F.substring(letters, F.pmod(each(i), F.length(letters)).cast("int") + 1, F.lit(1))
    hexes_only = raw.rlike("^[0-9a-fA-F]{12,}$")
    lower = F.when(hexes_only, "abcdef").otherwise("abcdefghijklmnopqrstuvwxyz")
    upper = F.upper(lower)
    greek, cyrillic = F.lit("αβγδεζηθικλμνξοπρστυφχψω"), F.lit("абвгдежзиклмнопрстуфхцчшщэюя")

    def place(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), pick(F.lit("0123456789"), i))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), F.upper(pick(greek, i)))
            .when(c.rlike(r"\p{IsGreek}"), pick(greek, i))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), F.upper(pick(cyrillic, i)))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(cyrillic, i))
            .when(c.rlike(r"\p{Lu}"), pick(upper, i))
            .when(c.rlike(r"\p{L}"), pick(lower, i))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(raw, ""), place), "")


def _name(hexes: Column, script: Column) -> Column:
    """A keyed name of six syllables in lower case, without ending."""
    out = None
    for s, syllables in _SYLLABLES.items():
        one = F.concat(*(F.element_at(F.array(*map(F.lit, syllables)), F.pmod(_number(hexes, 1 + 4 * k, 4), F.lit(len(syllables))).cast("int") + 1) for k in range(6)))
        out = F.when(script == s, one) if out is None else out.when(script == s, one)
    return out


def surrogate(what: Column, canon_: Column, h: Column) -> Column:
    """The replacement core of a canon: digits for numbers, else a full text.

    h is the column of hex digits that key, type, canon and attempt decide.
    A card keeps its length and passes the Luhn test if the original does; a
    phone has no country code here (its mentions keep theirs), a name no
    ending; an IP is a whole address; a well-known secret keeps the prefix that
    says its type; an e-mail has a new local part under example.com, example.net
    or example.org by its hash, and a label more if it had more than two.
    """
    prefix = F.when(what == "secret", F.regexp_extract(canon_, r"^(?:AKIA|gh[pousr]_|sk-)?", 0)).otherwise("")
    same = F.concat(prefix, _like(F.substring(canon_, F.length(prefix) + 1, F.length(canon_)), h))
    digits = F.when(F.substring(canon_, 1, 1) != "0", F.regexp_replace(same, "^0", "7")).otherwise(same)
    passes = canon_ == _luhn(canon_)
    checked = _luhn(digits)
    ip = F.concat_ws(".", *((F.pmod(_number(h, 1 + 8 * k), F.lit(222)) + (1 if k == 0 else 0)).cast("string") for k in range(4)))
    local = F.concat(F.translate(F.substring(h, 1, 12), "0123456789abcdef", "bcdfghjklmnpqrst"), F.when(canon_.rlike(r"[0-9]@"), F.concat(F.lit("."), (_number(h, 41, 4) % 90 + 10).cast("string"))).otherwise(""))
    host = F.element_at(F.array(F.lit("example.com"), F.lit("example.net"), F.lit("example.org")), (_number(h, 49, 4) % 3).cast("int") + 1)
    labels = F.size(F.split(F.regexp_extract(canon_, "@(.*)$", 1), r"\."))
    email = F.concat(local, F.lit("@"), F.when(labels > 2, F.concat(F.lit("mail"), (_number(h, 57, 4) % 9 + 1).cast("string"), F.lit("."))).otherwise(""), host)
    script = F.when(canon_.rlike(r"^[\p{IsCyrillic}]"), "Cyrillic").when(canon_.rlike(r"^[\p{IsGreek}]"), "Greek").otherwise("Latin")
    return F.when(what == "card", F.when(passes, checked).otherwise(digits)).when(what.isin("phone", "ssn"), digits).when(what == "ip", ip).when(what == "email", email).when(what.isin("given", "surname"), _name(h, script)).otherwise(same)


def _luhn(digits: Column) -> Column:
    """digits with its last one set so that the Luhn sum ends in zero."""
    stem = F.substring(digits, F.lit(1), F.length(digits) - 1)

    def weigh(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.transform(F.split(F.reverse(stem), ""), weigh), F.lit(0), lambda s, x: s + x)
    return F.concat(stem, F.pmod(-total, F.lit(10)).cast("string"))


def formatted(raw: Column, what: Column, core: Column, title: Column) -> Column:
    """The surrogate in the spelling of one mention: separators, case, gender."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    full = F.when(what == "phone", F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(core)), core)).otherwise(core)
    digit = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(full, F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)
    spread = F.array_join(F.transform(F.split(raw, ""), digit), "")
    upper = raw.rlike(r"\p{Lu}") & ~raw.rlike(r"\p{Ll}")
    female = F.regexp_replace(title, r"\.", "").isin(*FEMALE)
    ending = F.lit("")
    for s, (male_end, female_end) in _ENDING.items():
        ending = F.when((what == "given") & core.rlike(rf"^\p{{Is{s}}}"), F.when(female, female_end).otherwise(male_end)).otherwise(ending)
    name = F.concat(core, ending)
    name = F.when(raw.endswith("."), F.concat(F.upper(F.substring(core, 1, 1)), F.lit("."))).otherwise(F.concat(F.when(upper & (F.length(raw) > 1), F.upper(name)).otherwise(F.initcap(name)), F.regexp_extract(raw, "'s?$", 0)))
    return F.when(what.isin("ssn", "card", "phone"), spread).when((what == "email") & upper, F.upper(core)).when(what == "secret", F.concat(F.regexp_extract(raw, f"^(?:{_NAMED})?", 0), core)).when(what.isin("given", "surname"), name).otherwise(core)


def _exchanged(left: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """(kind, canon, core, attempt) for canons that no draw has room for.

    Those of one kind and length take each other's values in a keyed ring. No
    surrogate drawn is a real value, so these are distinct from all and from
    each other, and none is its own. Where one is alone, it takes a settled
    canon's value of its kind and length, or keeps its last draw if there is
    none. Only spaces that are full have such canons, so a ring is a small one.
    """
    size, place = F.length("canon"), F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon"), 256)
    ring = Window.partitionBy("kind", size).orderBy(place, "canon")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = left.withColumn("next", F.coalesce(F.lead("canon").over(ring), F.first("canon").over(whole)))
    alone = turned.where("next = canon").select("kind", "canon", "attempt", "core", size.alias("size"))
    others = real.join(left.select("kind", "canon"), ["kind", "canon"], "left_anti").groupBy("kind", size.alias("size")).agg(F.min("canon").alias("other"))
    lent = alone.join(others, ["kind", "size"], "left").select("kind", "canon", F.coalesce("other", "core").alias("core"), "attempt")
    return turned.where("next <> canon").select("kind", "canon", F.col("next").alias("core"), "attempt").unionByName(lent)


def assigned(entities: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """(kind, canon, core, attempt) for distinct (kind, canon): collision-free.

    Each round counts canons by surrogate, and surrogates that are a real canon
    of their kind. Of those that meet, the one with the fewest draws and then
    the least canon keeps it; the others draw again. The rounds end when none
    is left over; in a space that is nearly full that takes more rounds.
    """

    def draw(rows: DataFrame) -> DataFrame:
        seed = F.concat_ws("\x1f", F.lit(key), F.col("attempt").cast("string"), F.col("kind"))
        hashed = rows.withColumn("__h", _digits(F.col("canon"), seed))
        return hashed.select("kind", "canon", "attempt", surrogate(F.col("kind"), F.col("canon"), F.col("__h")).alias("core"))

    real = cut(entities.select("kind", "canon").distinct())
    state = cut(draw(real.withColumn("attempt", F.lit(0))))
    for _ in range(rounds):
        clash = state.groupBy("kind", "core").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).where("n > 1")
        lost = state.join(clash.select("kind", "core", F.col("first.canon").alias("winner")), ["kind", "core"]).where("canon <> winner").select("kind", "canon")
        taken = state.join(real.select("kind", F.col("canon").alias("core")), ["kind", "core"], "left_semi").select("kind", "canon")
        again = cut(lost.unionByName(taken).distinct())
        if again.isEmpty():
            return state
        redo = draw(state.join(again, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1))
        state = cut(state.join(again, ["kind", "canon"], "left_anti").unionByName(redo))
    left = state.join(again, ["kind", "canon"], "left_semi")
    return cut(state.join(again, ["kind", "canon"], "left_anti").unionByName(_exchanged(left, real, key)))


def _lists(matched: DataFrame, key: str) -> DataFrame:
    """(__key, __new): the surrogates in order for each distinct list of matches."""
    lists = matched.select(F.col("__list").alias("list"), F.col("__found").alias("found")).dropDuplicates(["list"])
    spread = lists.select("list", F.posexplode("found").alias("pos", "raw")).withColumn("kind", kind(F.col("raw")))
    title = F.when(F.col("kind") == "person", F.substring_index("raw", " ", 1)).otherwise("")
    each = spread.select("list", "pos", title.alias("title"), F.posexplode(parts(F.col("raw"), F.col("kind"))).alias("part", "p")).select("list", "pos", "title", "part", "p.kind", "p.raw")
    mentions = cut(each.withColumn("canon", canon(F.col("raw"), F.col("kind"))))
    known = assigned(mentions, key)
    new = formatted(F.col("raw"), F.col("kind"), F.col("core"), F.col("title"))
    said = mentions.join(known, ["kind", "canon"]).select("list", "pos", "part", "title", new.alias("new"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), " ")
    said = said.groupBy("list", "pos", "title").agg(F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), names).alias("new"))
    lines = said.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("new"))
    return cut(lines.select(F.col("list").alias("__key"), F.col("new.new").alias("__new")))


def replaced(docs: DataFrame, key: str = "surrogate key") -> DataFrame:
    """docs with surrogates in text, and n_entities and surrogates (an array).

    Texts are searched whole, once to find and keep those with a match and once
    to pass on the others, which take no part in any join. Of the matches only
    distinct lists travel until the last join. Rows may repeat or lack a doc_id;
    they are replaced alike. A null text stays null, with no entities; an empty
    table gives no rows. All columns of docs stay, whatever their names; only
    columns of the two names that are added here are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "surrogates")]
    some = F.col("text").rlike(_HINT) & F.col("text").rlike(PATTERN)
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))
    matched = docs.where(F.col("text").rlike(_HINT)).select(*names, found.alias("__found")).where(F.size("__found") > 0)
    matched = cut(matched.withColumn("__list", F.sha2(F.array_join("__found", "\x1f"), 256)))
    joined = matched.join(_lists(matched, key), F.col("__list") == F.col("__key"))
    pieces = F.split(F.col("text"), PATTERN, -1)
    text = F.array_join(F.zip_with(pieces, F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    put = [text.alias("text") if c == "text" else F.col(c) for c in names]
    done = joined.select(*put, F.size("__new").cast("long").alias("n_entities"), F.col("__new").alias("surrogates"))
    rest = docs.where(~F.coalesce(some, F.lit(False)))
    none = rest.select(*names, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("surrogates"))
    return done.unionByName(none)
