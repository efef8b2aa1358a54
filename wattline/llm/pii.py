"""Surrogates for personal data (operator 8, native: DataFrame functions only).

Entities found in whole texts: e-mail and IP addresses, phone, card, account
(IBAN) and social-security numbers, secrets (long hexadecimal keys, values after
token/password/...), and titled person names.  Each distinct entity gets one
keyed surrogate of its own type, the same wherever and however it is written:
forms that differ in case or separators share a normal form (coreference), and
a name's parts get theirs singly, so "Mr. John Smith" and "Mr. Smith" agree.
The surrogate is written in the form's own format: case, separators and lengths,
country code, top-level domain, valid octets, Luhn check digit, and for names
gender (by the title) and script (Latin, accented Latin, Cyrillic).

Distinctness: candidates are drawn by attempt number; a candidate that another
entity has or wants, or that is itself an entity of the corpus, goes to one
taker at most and the others draw again, until every entity has its own.  Where a
format is dense (hundreds of addresses like x@y.com) it grows from the
`grow_after`-th attempt on: addresses get letters before them, phone numbers digits
behind, names syllables.  (Formats of fixed length, cards, accounts, addresses of
hosts and social-security numbers, have over 10^8 values; if a corpus holds nearly
all of them, `most_attempts` draws end in an error.)

Texts go through the patterns once: each entity is put between two marks, and the
marked table is written; all else reads that.  Only the dictionary of distinct
entities is shuffled, and the texts that hold any.  A map by hash of the text
brings the surrogates to the texts, so copies share it; hot texts and hot entities
are spread by a salt (`common.give_back`).

Cases: null or empty text: unchanged, no entities.  Null or repeated doc_id:
of no concern, rows are told apart by their text.  Very long texts: whole.
Empty table: empty result.  Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import fresh, give_back, materialize

#: Patterns by type, in order of precedence (Java syntax, no capturing groups).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|3\d{3} \d{6} \d{5})(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,128}(?![\p{L}\p{N}])|(?<=(?i:token|secret|passwd|password|api_key|apikey)\s{0,3}[:=]\s{0,3}[\"']?)[A-Za-z0-9_+/=-]{12,}",
    "name": r"(?<![\p{L}\p{N}])(?:Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Herr|Frau|Señora|Señor|Sra|Sr|Madame|Mme|Monsieur|г-жа|г-н)\.? \p{Lu}[\p{Ll}'’-]+(?: \p{Lu}[\p{Ll}'’-]+){0,2}(?![\p{L}\p{N}])",
}
#: A text that matches none of this has no entity.
HINT = r"[@\d]|(?<![\p{L}\p{N}])(?:Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Herr|Frau|Señora|Señor|Sra|Sr|Madame|Mme|Monsieur|г-жа|г-н)\.? |(?i:token|secret|passwd|password|api_key|apikey)\s{0,3}[:=]"
ANY = "|".join(PATTERNS.values())
MALE, FEMALE = r"^(?:Mr|Herr|Señor|Sr|Monsieur|г-н)\b", r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа)\b"
#: Syllables and endings that names are made of, by script; endings by gender (m, f, u).
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha he ja jo ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te ti to va ve vi wa za zo",
    "accent": "bé bá dé dó fé gá hé jó ká lé lí ló má mé mí mó ná né nó pá ré rí ró sá sé só té tí tó vé ví zá zó",
    "cyrillic": "ба бе бо ва ве ви го да де ди до за зе ка ко ла ле ли ло ма ме ми мо на не но па по ра ре ро са се со та те ти то фе",
}
ENDINGS = {"latin": {"m": "n r s rt", "f": "na ra lia sa", "u": "l m"}, "accent": {"m": "n r s rt", "f": "na ra lia sa", "u": "l m"}, "cyrillic": {"m": "н р с в", "f": "на ра ла ва", "u": "ль м"}}


@dataclass(frozen=True)
class Params:
    key: str = "surrogate-key-1"
    grow_after: int = 3
    most_attempts: int = 300
    salts: int = 16


def mark(text: Column, p: Params = Params()) -> Column:
    """The mark of a text: a sequence of the key, or of the text's own hash where the text holds that one."""
    usual = "\ue000" + hashlib.sha256(f"mark:{p.key}".encode()).hexdigest()[:16] + "\ue001"
    return F.when(text.contains(usual), F.concat(F.lit("\ue000"), F.md5(text.cast("binary")), F.lit("\ue001"))).otherwise(F.lit(usual))


def marked(text: Column, mark_: Column) -> Column:
    """The text with each entity between two marks."""
    return F.when(text.rlike(HINT), F.regexp_replace(text, F.lit(ANY), F.concat(mark_, F.lit("$0"), mark_))).otherwise(text)


def type_of(form: Column) -> Column:
    """The type whose pattern an entity fits, in order of precedence (a secret may owe itself to what stands before it)."""
    return F.coalesce(*[F.when(form.rlike(f"^(?:{PATTERNS[t]})$"), t) for t in PATTERNS if t != "secret"], F.lit("secret"))


def _letters(s: Column) -> Column:
    """Letters and digits of a form in lower case: what a surrogate replaces one by one."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def _normal(kind: Column, form: Column) -> Column:
    spelled = F.when(kind.isin("email", "ip"), F.lower(form)).otherwise(_letters(form))
    return F.when(kind == "secret", form).otherwise(spelled)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (0-based) number in 0..65535 of a hexadecimal key stream."""
    return F.conv(F.substring(stream, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _stream(kind: Column, norm: Column, attempt: Column, key: str, n: int) -> Column:
    """Key stream of n hash blocks (16 numbers each)."""
    return F.concat(*[F.sha2(F.concat_ws("\x01", F.lit(key), kind, norm, attempt.cast("string"), F.lit(str(k))), 256) for k in range(n)])


def _pick(alphabet: str, v: Column) -> Column:
    return F.substring(F.lit(alphabet), (v % len(alphabet) + 1).cast("int"), F.lit(1))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string modulo 10."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise(
        F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _candidate(p: Params) -> Column:
    """A surrogate for the normal form `norm` of type `kind` at attempt `attempt` from its key stream `stream` (9
    blocks): same length in letters and digits, until the format grows."""
    kind, norm, attempt, stream = F.col("kind"), F.col("norm"), F.col("attempt"), F.col("stream")
    chars = F.split(norm, "")
    tld = F.length(norm) - F.length(F.regexp_extract(norm, r"\.[a-z0-9-]+$", 0))
    country = F.length(F.regexp_extract(norm, r"^1(?=\d{10}$)|^\d{2}(?=\d{9,}$)", 0))
    keep = (F.when(kind == "email", tld).otherwise(F.lit(1 << 30)), F.when(kind == "phone", country).when(kind == "iban", F.lit(2)).otherwise(F.lit(0)))

    def swap(c: Column, i: Column) -> Column:
        v = _byte(stream, i % 144)
        hexed = (kind == "secret") & norm.rlike("^[0-9a-fA-F]+$")
        return (F.when((i >= keep[0]) | (i < keep[1]), c)
                .when(c.rlike("[0-9]"), F.when(hexed, _pick("0123456789", v)).when((kind == "phone") & (i == keep[1]), _pick("23456789", v)).otherwise(_pick("0123456789", v)))
                .when(c.rlike("[a-z]"), F.when(hexed, _pick("abcdef", v)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", v)))
                .when(c.rlike("[A-Z]"), F.when(hexed, _pick("ABCDEF", v)).otherwise(_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", v)))
                .otherwise(c))

    plain = F.array_join(F.transform(chars, swap), "")
    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: F.when((F.length(o) == 3) & (attempt < 6), 100 + _byte(stream, i) % 156)
                                      .when((F.length(o) == 2) & (attempt < 6), 10 + _byte(stream, i) % 90).when(attempt < 6, _byte(stream, i) % 10)
                                      .otherwise(_byte(stream, i) % 256).cast("string")), ".")
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    # the last digit makes the Luhn sum what the original's is
    fix = F.concat(body, F.pmod(_luhn(norm) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    more = F.when(attempt >= p.grow_after, F.floor((attempt - p.grow_after) / 2).cast("int") + 1).otherwise(F.lit(0))
    extra = lambda alphabet: F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _pick(alphabet, _byte(stream, 143 - i % 100))), "")).otherwise(F.lit(""))
    return (F.when(kind == "ip", octets).when(kind == "card", fix).when(kind.startswith("name:"), _name(stream, kind, attempt))
            .when(kind == "email", F.concat(extra("abcdefghijklmnopqrstuvwxyz"), plain)).when(kind == "phone", F.concat(plain, extra("0123456789"))).otherwise(plain))


def _name(stream: Column, kind: Column, attempt: Column) -> Column:
    """A name part of kind name:<role>:<gender>:<script>; it has a syllable more from every third attempt."""
    out = None
    for script, syllables in SYLLABLES.items():
        parts = syllables.split(" ")
        arr = F.array(*[F.lit(x) for x in parts])
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + F.floor(attempt / 3).cast("int")), lambda i: F.get(arr, _byte(stream, i) % len(parts))), "")
        ending = None
        for g, ends in ENDINGS[script].items():
            e = ends.split(" ")
            one = F.get(F.array(*[F.lit(x) for x in e]), _byte(stream, F.lit(30)) % len(e))
            cond = kind.contains(f":{g}:")
            ending = F.when(cond, one) if ending is None else ending.when(cond, one)
        word = F.concat(stem, ending)
        cond = kind.endswith(f":{script}")
        out = F.when(cond, word) if out is None else out.when(cond, word)
    return out


def _spelled(form: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate in the format of a form: letters and digits take turns, the rest stays, case as it was.  What a
    grown surrogate has more stands before an address, behind a number."""
    every = F.regexp_replace(surrogate, "[^A-Za-z0-9]", "")
    more = F.greatest(F.lit(0), F.length(every) - F.length(F.regexp_replace(form, "[^A-Za-z0-9]", "")))
    lead = F.when(kind == "email", more).otherwise(F.lit(0))
    s = F.substring(every, lead + 1, F.length(every) - more)
    chars = F.split(form, "")
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(form))), lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), "[^A-Za-z0-9]", "")))
    out = F.array_join(F.zip_with(chars, at, lambda c, k: F.when(~c.rlike("[A-Za-z0-9]"), c).when(c.rlike("[A-Z]"), F.upper(F.substring(s, k, F.lit(1)))).otherwise(F.substring(s, k, F.lit(1)))), "")
    tail = F.when(kind == "email", F.lit("")).otherwise(F.substring(every, F.length(every) - more + 1, F.length(every)))
    return F.when(kind.isin("ip", "secret"), surrogate).otherwise(F.concat(F.substring(every, F.lit(1), lead), out, tail))


def assign(entities: DataFrame, p: Params = Params()) -> DataFrame:
    """entities (kind, norm), distinct -> (kind, norm, surrogate): distinct within a kind, none an entity itself."""
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = materialize(entities.select("kind", "norm").distinct(), "pii-entities")
    done: DataFrame | None = None
    todo = entities
    for attempt in range(p.most_attempts):
        # few bytes make few files, but a draw takes a while for each row: dealt to all tasks
        drawn = todo.repartition(tasks, "kind", "norm").withColumn("attempt", F.lit(attempt))
        drawn = drawn.withColumn("stream", _stream(F.col("kind"), F.col("norm"), F.col("attempt"), p.key, 9)).withColumn("surrogate", _candidate(p))
        drawn = materialize(drawn.select("kind", "norm", "surrogate"), "pii-drawn")
        free = drawn.join(entities.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        winner = free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).select("kind", "norm", "surrogate")
        new = winner if done is None else done.unionByName(winner)
        done = materialize(new, "pii-assigned")
        todo = materialize(entities.join(done, ["kind", "norm"], "left_anti"), "pii-open")
        if todo.isEmpty():
            return done
    raise RuntimeError(f"{p.most_attempts} attempts left entities without a surrogate of their own")


def dictionary(forms: DataFrame, p: Params = Params()) -> DataFrame:
    """forms (form), distinct -> (form, kind, replacement)."""
    form = F.col("form")
    typed = materialize(forms.select("form", type_of(form).alias("kind")), "pii-forms")
    plain = typed.filter("kind <> 'name'").withColumn("norm", _normal(F.col("kind"), form))
    names = typed.filter("kind = 'name'")
    title = F.regexp_extract(form, r"^\S+ ", 0)
    gender = F.when(form.rlike(FEMALE), "f").when(form.rlike(MALE), "m").otherwise("u")
    script = F.when(F.col("norm").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("norm").rlike(r"[^\x00-\x7F’]"), "accent").otherwise("latin")
    tokens = F.split(F.substring(form, F.length(title) + 1, F.length(form)), " ")
    parts = names.select("form", title.alias("title"), gender.alias("gender"), F.size(tokens).alias("n"), F.posexplode(tokens).alias("pos", "norm"))
    role = F.when(F.col("pos") == F.col("n") - 1, F.concat_ws(":", F.lit("name:last:u"), script)).otherwise(F.concat_ws(":", F.lit("name:first"), F.col("gender"), script))
    parts = parts.withColumn("kind", role).withColumn("norm", F.lower("norm"))
    given = assign(plain.select("kind", "norm").union(parts.select("kind", "norm")), p)
    a = plain.join(given, ["kind", "norm"]).select("form", "kind", _spelled(form, F.col("surrogate"), F.col("kind")).alias("replacement"))
    b = parts.join(given, ["kind", "norm"]).groupBy("form", "title").agg(F.array_sort(F.collect_list(F.struct("pos", F.initcap("surrogate").alias("s")))).alias("x"))
    b = b.select("form", F.lit("name").alias("kind"), F.concat(F.col("title"), F.array_join(F.col("x.s"), " ")).alias("replacement"))
    return a.union(b)


def replace_pii(docs: DataFrame, p: Params = Params(), text: str = "text", count: str | None = None) -> DataFrame:
    """docs with entities in `text` replaced by surrogates; all columns stay.  count: name of a column to add, entities per row."""
    k_mark, k_text, k_n, k_key, k_salt = (fresh(docs, c) for c in ("pii_mark", "pii_text", "pii_n", "pii_key", "pii_salt"))
    t = F.col(f"`{text}`").cast("string")
    rows = docs.withColumn(k_mark, mark(t, p)).withColumn(k_text, marked(t, F.col(k_mark)))
    n = F.call_function("div", F.length(k_text) - F.length(t), 2 * F.length(k_mark))
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], k_text, k_mark, F.coalesce(n, F.lit(0).cast("long")).alias(k_n),
                       F.md5(F.coalesce(t, F.lit("")).cast("binary")).alias(k_key), F.pmod(F.monotonically_increasing_id(), F.lit(p.salts)).cast("int").alias(k_salt))
    rows = materialize(rows, "pii-marked")
    some = rows.filter(F.col(k_n) > 0)
    pieces = F.split(F.col(k_text), F.col(k_mark), -1)  # every second one is an entity
    forms = F.array_distinct(F.filter(pieces, lambda _, i: i % 2 == 1))
    # once written: each distinct text with its distinct forms
    uses = some.select(F.col(k_key).alias("tkey"), F.explode(forms).alias("form")).distinct()
    uses = materialize(uses.select("tkey", "form", F.pmod(F.hash("tkey"), F.lit(p.salts)).alias("salt")), "pii-uses")
    words = materialize(dictionary(uses.select("form").distinct(), p), "pii-dictionary")
    maps = give_back(uses, "form", "salt", words.select("form", "replacement")).groupBy("tkey").agg(F.map_from_entries(F.collect_list(F.struct("form", "replacement"))).alias("to"))
    k_map = fresh(docs, "pii_map")
    with_map = give_back(some, k_key, k_salt, maps.select(F.col("tkey").alias(k_key), F.col("to").alias(k_map)))
    new = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(F.col(k_map), x), x)).otherwise(x)), "")
    add = [F.col(k_n).alias(count)] if count else []
    every = lambda out: [out.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns] + add
    return rows.filter(F.col(k_n) == 0).select(*every(F.col(k_text))).union(with_map.select(*every(new)))
