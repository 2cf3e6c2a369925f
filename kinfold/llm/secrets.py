"""Secret scans: candidates by pattern, a random forest as one expression, DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import release

#: Runs of key-like characters that hold a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{8,}+={0,2}"
BEFORE, AFTER = 32, 16
#: Words whose letters, found in a candidate, count as covered by the dictionary.
DICTIONARY = "example|request|default|version|profile|config|report|release|github|google|image|index|media|build|string|object|number|thread|worker|server|client|sample|change|your|here|user|data|file|name|test|page|main|java|node|http|html|json|list|item|type|info|model|order|photo|final|draft|mail|home|this|that|with|from|tion|ment|able|ness|ing|the|and|for|get|set|src|lib|usr|bin|var|log|doc|img|api|web|app|net|com|org|day|new|old"
SECRET_WORDS = r"(token|secret|passw(or)?d|passwd|pwd|key|auth|bearer|credentials?)[\"'\]]?\s*(is|[=:]>?)?\s*[\"']?$"
PLAIN_WORDS = r"(commit|sha-?\d*|md5|checksum|hash|uuid|guid|digest|etag|version|revision|blob|order|card|phone|page|id|ref|build|run|line)[\"']?\s*[=:#]?\s*[\"']?$"
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "turns", "distinct", "hexadecimal", "covered", "path", "near_secret", "near_plain", "assigned", "quoted", "prefix")

#: Values assigned to a secret word, with the word: no digit is needed, punctuation is part of the value, 4 characters do.
_WORD = r"(?:token|secret|passw(?:or)?d|passwd|passphrase|pwd|key|auth|bearer|credentials?)"
_LINK = r"[\"'\]]{0,2}\s{0,4}(?::=|={1,3}>?|:|is\s)\s{0,4}"
_VALUE = r"(?:\"[^\"\s]{4,}+(?=\")|'[^'\s]{4,}+(?=')|[^\s\"'`<>,;]{3,}[^\s\"'`<>,;.:?)\]}])"
ASSIGNED = rf"(?i){_WORD}{_LINK}(?!{_WORD}[\"'\]]{{0,2}}\s{{0,4}}[=:]){_VALUE}"
ASSIGNMENT = rf"(?i)^{_WORD}{_LINK}[\"']?"
KEY_LIKE = r"^(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{8,}+={0,2}$"
STRONG = r"(passw(or)?d|passwd|passphrase|pwd|secret|credentials?)[\"'\]]{0,2}\s*(is\s|[=:])"
PLACEHOLDER = r"^(none|null|nil|true|false|undefined|required|optional|string|hidden|redacted|masked|chang|exampl|test|empty|wrong|(in)?correct|(in)?valid|expired|missing|not|the|your|my[-_]|enter|insert|xxx|[*.$%{\[_<-]|(process|os|env|self|this|request|args|config|options|settings)[.\[])"
VALUE_FEATURES = (*FEATURES, "strong", "placeholder", "call", "word")
#: Stands for a value that goes while a text is cut there; the same character in a text is escaped.
CUT, KEPT = "\x01!", "\x01-"


def features(text: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers that describe a candidate and its neighbours."""
    n = F.length(text).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0"), "[^Aa0]", "-")
    flag = lambda c: c.cast("double")
    left, right = F.lower(before), F.lower(after)
    return {
        "length": n,
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "lowers": share("[^a-z]"),
        "marks": share("[A-Za-z0-9]"),
        "turns": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / F.least(n, F.lit(32.0)),
        "hexadecimal": flag(text.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(text), DICTIONARY, "")) / n,
        "path": flag(text.rlike(r"/[^/]*[a-z]{3}[^/]*/") | right.rlike(r"^\.[a-z]{1,4}\b") | left.rlike(r"(\w[.:]//?|[/.@\\])$") | right.rlike(r"^[@\\]")),
        "near_secret": flag(left.rlike(SECRET_WORDS)),
        "near_plain": flag(left.rlike(PLAIN_WORDS)),
        "assigned": flag(left.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(left.rlike("[\"']$") & right.rlike("^[\"']")),
        "prefix": flag(text.rlike("^(AKIA|ASIA|ghp_|gho_|sk_|xox[abp]-|eyJ)")),
    }


def candidates(text: Column) -> Column:
    """array<struct<ordinal, text, features…>> of a whole text: what the pattern finds, and between it the gaps."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    found = F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(whole, CANDIDATE, -1)
    parts = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda c, g: F.struct(c.alias("text"), F.right(g, F.lit(BEFORE)).alias("before")))
    parts = F.zip_with(parts, F.slice(gaps, F.lit(2), F.size(found)), lambda p, g: F.struct(p["text"].alias("text"), p["before"].alias("before"), F.left(g, F.lit(AFTER)).alias("after")))
    return F.transform(parts, lambda p, i: F.struct(i.alias("ordinal"), p["text"].alias("text"), *[v.alias(k) for k, v in features(p["text"], p["before"], p["after"]).items()]))


def values(text: Column) -> Column:
    """array<struct<match, text, features…>> of the values that a whole text assigns to secret words.

    A value that is key-like as a whole is a candidate anyway and is left to that forest: its features are null.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.transform(F.regexp_extract_all(whole, F.lit(ASSIGNED), F.lit(0)), lambda m: F.struct(m.alias("match"), F.regexp_replace(m, ASSIGNMENT, "").alias("text")))

    def described(p: Column) -> Column:
        v = p["text"]
        before = F.left(p["match"], F.length(p["match"]) - F.length(v))
        quote = F.regexp_extract(before, "[\"']$", 0)
        more = {
            "strong": F.lower(before).rlike(STRONG).cast("double"),
            "placeholder": F.lower(v).rlike(PLACEHOLDER).cast("double"),
            "call": v.rlike(r"[(\[{]|://|::|->|^/|^[A-Za-z_]+(\.[A-Za-z_]+)+$").cast("double"),
            "word": v.rlike("^[A-Z]?[a-z]+$").cast("double"),
        }
        own = ~v.rlike(KEY_LIKE)
        return F.struct(p["match"].alias("match"), v.alias("text"), *[F.when(own, f).alias(k) for k, f in (features(v, before, quote) | more).items()])

    return F.transform(parts, described)


def labelled_findings(spark: SparkSession, rows: int = 4800) -> DataFrame:
    """(doc_id, text, secret): made snippets, each with one finding that was judged.

    Real keys are never shipped; the judged kinds are keys, tokens and passwords in assignments on one
    side, and commits, checksums, identifiers, paths, card numbers, placeholders and words with digits on
    the other. Values come from hashes of the row number. rows bounds the sample.
    """
    i = F.col("id")
    h = F.sha2(F.concat(i.cast("string"), F.lit("finding")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[=\r\n]", "")
    word = F.element_at(F.split(F.lit(DICTIONARY), r"\|"), (1 + F.pmod(F.xxhash64("id"), F.lit(70))).cast("int"))
    other = F.element_at(F.split(F.lit(DICTIONARY), r"\|"), (1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(70))).cast("int"))
    digits = F.regexp_replace(F.conv(F.substring(h, 1, 15), 16, 10), "^(.{16}).*", "$1")
    some = (8 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(25))).cast("int")
    cut = lambda x, n: F.substring(x, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    upper = F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    keys = [
        text('token = "', cut(h, 40), '"'), text("password=", cut(h, some)), text("AKIA7", cut(upper, 15)),
        text("api_key: ", cut(b64, 32)), text('"secret": "', cut(b64, 40), '"'), text("ghp_0", cut(b64, 35)),
        text("Authorization: Bearer ", b64), text("pwd = '", cut(b64, some), "'"), text("key=", cut(h, 32)),
        text('TOKEN = "', F.upper(cut(h, 40)), '"'), text("PASSWORD=", F.upper(cut(h, some))), text("the token is ", cut(b64, 24)),
    ]
    plain = [
        text("commit ", cut(h, 40)), text("md5 ", cut(h, 32)), text("id: ", cut(h, 8), "-", cut(h, 4), "-4a1b-9c3d-", cut(h, 12)),
        text("see /", word, "/", other, "/", word, "_", cut(digits, 3), "/", other, ".html"), text("card ", digits), text(digits, " "),
        text("password=", word, other, "123"), text('token = "your-', word, '-here-1"'), text(word, "_", other, "_", word, "_", cut(digits, 2)),
        text(word, other, "_", cut(digits, 2), "@mail3.example.com"), text("on 2024-", cut(digits, 2), "-11 and ", word, other, "2"), text("call +49-30-", cut(digits, 8)),
    ]
    around = lambda c: F.concat(word, F.lit(" of "), other, F.lit(" "), c, F.lit(" and "), word)
    pick = lambda xs: F.element_at(F.array(*map(around, xs)), (1 + F.floor(i / 2) % len(xs)).cast("int"))
    return spark.range(rows).select(i.alias("doc_id"), F.when(i % 2 == 0, pick(keys)).otherwise(pick(plain)).alias("text"), (1 - i % 2).cast("int").alias("secret"))


def assigned_findings(spark: SparkSession, rows: int = 4800) -> DataFrame:
    """(doc_id, text, secret): made snippets, each with one judged value after a secret word.

    Secrets are letters without digits, joined words, short words with digits and values with punctuation;
    the others are placeholders, plain words, numbers, addresses, paths and pieces of code.
    """
    i = F.col("id")
    h = F.sha2(F.concat(i.cast("string"), F.lit("assigned")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[=\r\n]", "")
    letters = F.regexp_replace(F.concat(b64, F.base64(F.unhex(F.sha2(h, 256)))), "[^A-Za-z]", "")
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    one = lambda k, words: F.element_at(F.split(F.lit(words), r"\|"), 1 + draw(k, words.count("|") + 1))
    pet = "correct|horse|battery|staple|dragon|monkey|hunter|winter|purple|tiger|coffee|rocket|silver|guitar|pepper|orange|falcon|lucky|summer|banana|turtle|castle|violet|thunder"
    odd = lambda k: one(k, "!|@|#|$|%|^|&|*|?|~")
    cut = lambda x, n: F.substring(x, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    number = cut(F.regexp_replace(F.conv(cut(h, 15), 16, 10), "^(.{9}).*", "$1"), 2 + draw(20, 5))
    strong = F.concat(one(1, "password|passwd|pwd|db_password|PASSWORD|secret|client_secret|Password|credentials"), one(2, "=|: | = |\": |:"))
    weak = F.concat(one(3, "token|api_key|key|auth|access_token|API_KEY|apikey"), one(4, "=|: | = |\": |:"))
    either = F.when(draw(5, 2) == 0, strong).otherwise(weak)
    quote = one(6, "|\"|'|\"")
    word = F.element_at(F.split(F.lit(DICTIONARY), r"\|"), 1 + draw(7, 50))
    other = F.element_at(F.split(F.lit(DICTIONARY), r"\|"), 1 + draw(8, 50))
    held = lambda front, value: text(front, quote, value, quote)
    mixed = text(cut(letters, 2 + draw(9, 6)), odd(10), cut(h, 1 + draw(11, 6)), odd(12), number)
    keys = [
        held(either, cut(letters, 8 + draw(13, 25))), held(strong, text(one(14, pet), one(15, pet), one(16, pet))), held(strong, text(one(14, pet), cut(number, 1 + draw(17, 2)))),
        held(either, mixed), held(strong, text(one(14, pet), odd(10), one(15, pet))), held(strong, text(F.initcap(one(14, pet)), odd(10), cut(number, 3))),
        held(strong, text(one(14, pet), one(15, pet))), text("the ", one(1, "password|secret|passwd"), " is ", mixed), held(either, text(cut(letters, 12), odd(10), cut(letters, 4))),
        text("the ", one(18, "token|key|password"), " is ", cut(letters, 16 + draw(13, 17))), held(strong, cut(letters, 5 + draw(13, 6))), held(strong, text("P@ssw0rd", odd(10), number)),
    ]
    plain = [
        held(either, one(14, "none|null|true|false|undefined|required|optional|string|changeme|redacted|your_token|your-key|xxxxxx|********|<token>|${TOKEN}|%(password)s|{{secret}}|$SECRET")),
        held(weak, word), held(weak, one(14, pet)), held(weak, text(word, one(19, "_|-|."), other)), held(either, text(word, one(19, "_|-|."), other)),
        text(either, one(14, "os.environ|self.token|config.get(|getToken()|request.headers|process.env.KEY|args.password|read_secret(|settings.auth|[REDACTED]")),
        text("the ", one(18, "password|token|key|secret"), " is ", one(14, "required|incorrect|expired|missing|invalid|wrong|patience|simple|needed|shared|stored|there|optional|nothing|always|never")),
        text(weak, number), text(either, "https://", word, ".example.com/", other), text(either, "/", word, "/", other), held(weak, F.initcap(one(15, pet))), text("Key: ", word, " ", other),
    ]
    pick = lambda xs: F.element_at(F.array(*xs), (1 + F.floor(i / 2) % len(xs)).cast("int"))
    return spark.range(rows).select(i.alias("doc_id"), F.concat(word, F.lit(" "), F.when(i % 2 == 0, pick(keys)).otherwise(pick(plain)), F.lit(" and "), other).alias("text"), (1 - i % 2).cast("int").alias("secret"))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple | float:
    """A tree of least Gini impurity: (feature, threshold, left if <=, right), or a leaf's share of secrets."""
    mean = float(y.mean())
    if depth == 0 or len(y) < 8 or mean in (0.0, 1.0):
        return round(mean, 6)
    best: tuple = (mean * (1 - mean) * len(y) - 1e-9, None)
    for f in rng.choice(x.shape[1], 4, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            n, k = cut + 1, s[cut]
            m, j = len(y) - n, s[-1] - k
            gini = k * (n - k) / n + j * (m - j) / m
            a = int(np.argmin(gini))
            if gini[a] < best[0]:
                best = (gini[a], (int(f), float((v[cut[a]] + v[cut[a] + 1]) / 2)))
    if best[1] is None:
        return round(mean, 6)
    f, t = best[1]
    go = x[:, f] <= t
    return (f, t, grow(x[go], y[go], rng, depth - 1), grow(x[~go], y[~go], rng, depth - 1))


def train_forest(findings: DataFrame, trees: int = 15, depth: int = 5, seed: int = 5, found=candidates, names: tuple[str, ...] = FEATURES) -> list:
    """Trees over bootstrap samples of a bounded table (doc_id, text, secret); its features come from the
    same expressions that the scan uses. found: what of a text is judged, names: its features."""
    rows = findings.select("doc_id", "secret", F.explode(found(F.col("text"))).alias("c")).select("doc_id", "secret", *[F.col(f"c.{k}") for k in names]).where(F.col(names[0]).isNotNull()).orderBy("doc_id", *names).collect()
    x, y = np.array([r[2:] for r in rows], float), np.array([r[1] for r in rows], float)
    if not len(y):
        return [0.0]
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        forest.append(grow(x[own], y[own], rng, depth))
    release(findings.sparkSession)
    return forest


def train_values(findings: DataFrame, depth: int = 8) -> list:
    """The forest for values assigned to secret words."""
    return train_forest(findings, depth=depth, found=values, names=VALUE_FEATURES)


def forest_score(forest: list, value, names: tuple[str, ...] = FEATURES) -> Column:
    """The trees' mean as one expression; value(name) is a feature's column."""

    def tree(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        return F.when(value(names[t[0]]) <= F.lit(t[1]), tree(t[2])).otherwise(tree(t[3]))

    return sum((tree(t) for t in forest[1:]), tree(forest[0])) / float(len(forest))


def judged(text: Column, forest: list) -> Column:
    """array<struct<ordinal, text, score>> of all candidates of a whole text."""
    return F.transform(candidates(text), lambda c: F.struct(c["ordinal"].alias("ordinal"), c["text"].alias("text"), forest_score(forest, lambda k: c[k]).alias("score")))


def judged_values(text: Column, forest: list) -> Column:
    """array<struct<match, text, score>> of the values that a whole text assigns to secret words; key-like ones have score 0 here."""
    score = lambda v: F.when(v["length"].isNull(), F.lit(0.0)).otherwise(forest_score(forest, lambda k: v[k], VALUE_FEATURES))
    return F.transform(values(text), lambda v: F.struct(v["match"].alias("match"), v["text"].alias("text"), score(v).alias("score")))


def cut_at_values(text: Column, taken: Column) -> Column:
    """array<string>: the text's pieces around the values of taken (as judged_values gives them, with a flag hit) that are hits."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    safe = lambda c: F.replace(c, F.lit(CUT[0]), F.lit(KEPT))
    shown = F.transform(taken, lambda v: F.when(v["hit"], F.concat(safe(F.left(v["match"], F.length(v["match"]) - F.length(v["text"]))), F.lit(CUT))).otherwise(safe(v["match"])))
    joined = F.array_join(F.zip_with(F.split(whole, ASSIGNED, -1), shown, lambda g, v: F.concat(safe(g), F.coalesce(v, F.lit("")))), "")
    return F.transform(F.split(joined, CUT, -1), lambda p: F.replace(p, F.lit(KEPT), F.lit(CUT[0])))


def with_pieces(docs: DataFrame, values_forest: list, least: float) -> DataFrame:
    """docs with _taken (the values that are secrets) and _pieces (the text around them)."""
    flagged = F.transform(judged_values(F.col("text"), values_forest), lambda v: F.struct(v["match"].alias("match"), v["text"].alias("text"), v["score"].alias("score"), (v["score"] >= least).alias("hit")))
    out = docs.withColumn("_flagged", flagged)
    return out.withColumn("_pieces", cut_at_values(F.col("text"), F.col("_flagged"))).withColumn("_taken", F.filter("_flagged", lambda v: v["hit"])).drop("_flagged")


def scan(docs: DataFrame, forest: list, least: float = 0.5, values_forest: list | None = None) -> DataFrame:
    """One row a secret: doc_id, ordinal (among the text's candidates, from 0), secret_length, secret_sha256, score.

    values_forest judges what is assigned to secret words; without it only key-like runs are looked at. What it
    finds splits the text, counts as a candidate there, and the pieces are scanned for key-like runs.
    The value itself isn't repeated in the result. Null and empty texts give no rows; repeated rows are
    scanned each; nothing is shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = judged(F.col("text"), forest)
    if values_forest is not None:
        docs = with_pieces(docs, values_forest, least)
        bare = lambda c: F.struct(c["text"].alias("text"), c["score"].alias("score"))
        around = F.zip_with("_pieces", "_taken", lambda p, v: F.concat(F.transform(judged(p, forest), bare), F.when(v.isNull(), F.array().cast("array<struct<text:string,score:double>>")).otherwise(F.array(bare(v)))))
        found = F.transform(F.flatten(around), lambda c, i: F.struct(i.alias("ordinal"), c["text"].alias("text"), c["score"].alias("score")))
    rows = docs.select("doc_id", F.explode(found).alias("c")).where(F.col("c.score") >= least)
    return rows.select("doc_id", F.col("c.ordinal").alias("ordinal"), F.length("c.text").alias("secret_length"), F.sha2("c.text", 256).alias("secret_sha256"), F.round("c.score", 6).alias("score"))


def masked(text: Column, forest: list, least: float, mask: str) -> Column:
    """A text that isn't null, with each key-like secret replaced by the mask."""
    shown = F.transform(judged(text, forest), lambda c: F.when(c["score"] >= least, F.lit(mask)).otherwise(c["text"]))
    return F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), shown, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")


def redact(docs: DataFrame, forest: list, least: float = 0.5, mask: str = "[SECRET]", values_forest: list | None = None) -> DataFrame:
    """docs with each secret of text replaced by the mask; n_chars, if there, counts the new text.

    values_forest judges what is assigned to secret words, as in scan().
    """
    if values_forest is None:
        joined = masked(F.coalesce(F.col("text").cast("string"), F.lit("")), forest, least, mask)
        out = docs
    else:
        out = with_pieces(docs, values_forest, least)
        joined = F.array_join(F.transform("_pieces", lambda p: masked(p, forest, least, mask)), mask)
    out = out.withColumn("text", F.when(F.col("text").isNull(), F.lit(None)).otherwise(joined)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
