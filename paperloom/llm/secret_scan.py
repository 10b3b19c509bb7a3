"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Names that secrets are assigned to.
KEYWORDS = "passw(?:or)?d|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|client.?key|auth(?:orization)?|bearer|credentials?"
#: What may be a secret: a private key block; a dotted web token; any value of six characters
#: or more that is assigned to such a name; and a run of at least 16 letters, digits and
#: + / _ - with a digit in it, and the = that pad it.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,8192}-----END [A-Z ]{0,24}PRIVATE KEY-----"
    r"|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    rf"|(?<=[=: \t\"'`])(?<=[:=][ \t]{{0,2}}[\"'`]?)(?<=(?i:{KEYWORDS})[A-Za-z_]{{0,12}}[\"']?[ \t]{{0,2}}[:=]{{1,2}}[ \t]{{0,2}}[\"'`]?)[^\s\"'`,;<>]{{6,256}}+"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
LEFT, RIGHT = 48, 24
REDACTED = "[SECRET]"
FINDINGS, TREES, DEPTH, SEED = 9000, 15, 6, 7
#: Words of names, paths and placeholders, which secrets are not made of.
DICTIONARY = (
    "account admin apple archive article build cache class client code color config configuration content count create data date default delete department demo design "
    "document download error event example file filter final format forum function group guide header home html image index info item java language library link list "
    "local login main manager message model module name network news number object order output page part path photo placeholder plan post price product profile "
    "project public python query release report request resource result sample schema search section server service session simple source spring start state static "
    "status store string style summer support system table template test text time title tree type update upload user value version video view water window winter world your"
).split()
FEATURES = ("size", "digits", "uppers", "lowers", "marks", "turns", "kinds", "hex", "known", "slashes", "pathlike", "keyword", "assigned", "quoted", "benign", "holder", "only_digits", "others", "calls", "words", "key_block")


def _share(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[{keep[1:]}]" if keep[0] == "^" else f"[^{keep}]", "")) / F.greatest(F.length(text), F.lit(1))


def features(left: Column, found: Column, right: Column) -> list[Column]:
    """Length, shares and changes of character kinds, dictionary coverage, path signs and the words around a candidate."""
    low, before = F.lower(found), F.lower(left)
    n = F.greatest(F.length(found), F.lit(1))
    flag = lambda c: c.cast("double")
    return [
        F.length(found).cast("double"),
        _share(found, "0-9"),
        _share(found, "A-Z"),
        _share(found, "a-z"),
        _share(found, "+/_="),
        F.regexp_count(found, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")) / n,
        F.size(F.array_distinct(F.split(low, ""))) / n,
        flag(low.rlike("^[0-9a-f]+$")),
        1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        F.length(F.regexp_replace(found, "[^/]", "")).cast("double"),
        flag(left.rlike(r"[/.\\~]$") | right.rlike(r"^(\.[a-z]{1,5}\b|/)")),
        flag(before.rlike(rf"({KEYWORDS})[a-z_]*[^a-z0-9]{{0,6}}$")),
        flag(left.rlike("[=:]\\s*[\"'`]?$")),
        flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        flag(before.rlike(r"(commit|sha-?[0-9]*|md5|checksum|digest|uuid|guid|revision|rev|version|hash|etag|build|order|invoice|phone|card)[^a-z0-9]{0,4}$")),
        flag(low.rlike("example|sample|dummy|placeholder|changeme|your|x{5,}|0{6,}|123456|abcdef")),
        flag(found.rlike("^[0-9]+$")),
        _share(found, r"^A-Za-z0-9+/_=\s-"),
        flag(found.rlike(r"[({\[]|^[a-z_]+(\.[a-z_]+)+$|^\$|^%|->|::")),
        flag(found.rlike(r"^[A-Z]?[a-z]{2,}([._ -][a-z]{2,})*[.!?)]*$|^[A-Z_]{2,}$")),
        flag(found.rlike("PRIVATE KEY-----$|^eyJ[A-Za-z0-9_-]+[.]")),
    ]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(left, found, right, label, id): findings of eighteen kinds made by rule from hashes of their numbers, half of them secrets."""
    part = lambda name: F.sha2(F.concat(F.col("id").cast("string"), F.lit(name)).cast("binary"), 256)
    hexes, noise = part("a"), F.regexp_replace(F.base64(F.unhex(part("b"))), "=", "")
    alnum = F.regexp_replace(F.concat(noise, F.regexp_replace(F.base64(F.unhex(part("e"))), "=", "")), "[+/]", "")
    pick = lambda name, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(name)), F.lit(len(xs))) + 1).cast("int"))
    digits = F.regexp_replace(F.concat(part("c"), part("d")), "[a-f]", "")
    word = pick("w1", "the ", "of in ", "see ", "and then ", "", "It was ", "eau ", "der ", "here. ", ", ")
    quote = pick("q", '"', '"', "'", "")
    sign = pick("s", " = ", "=", ": ", ":", " := ")
    names = pick("n", "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "TOKEN", "API_KEY", "Secret")
    titled = lambda i: F.element_at(F.array(*(F.lit(w) for w in DICTIONARY)), (F.pmod(F.xxhash64("id", F.lit(f"d{i}")), F.lit(len(DICTIONARY))) + 1).cast("int"))
    set_to = F.concat(word, names, sign, quote)
    letters = F.translate(hexes, "0123456789abcdef", "QwErTyUiOpAsDfGh")
    plain = pick("v", "string", "null", "none", "undefined", "required", "optional", "changed", "expired", "invalid", "missing", "something", "nothing", "whatever", "because", "they", "which", "people", "authentication", "management", "reset", "forgotten", "protected", "your-password", "password", "enabled", "true", "false", "economics")
    called = pick("v2", "getpass.getpass()", "os.environ[", "request.headers.get(", "config.password", "self.token", "settings.SECRET_KEY", "${DB_PASSWORD}", "$TOKEN", "%s", "{token}", "user.password_hash", "get_secret(", "None)", "str(value)", "args.token")
    marked = F.concat(F.substring(letters, 3, 3), pick("m", "!", "@", "#", "$", "%", "&", "*", "?", "-", "_"), F.substring(digits, 3, pick("l2", 2, 3, 4).cast("int")), F.substring(letters, 11, 3), pick("m2", "!", "", "$", "^", "+", ""))
    kinds = [
        (set_to, F.concat(F.initcap(titled(5)), F.substring(digits, 2, pick("l3", 2, 3, 4).cast("int")), pick("m3", "!", "#", "$", "", "@", "?")), quote, 1),
        (set_to, marked, quote, 1),
        (set_to, F.substring(letters, 1, pick("l4", 12, 16, 20, 24, 32).cast("int")), quote, 1),
        (F.concat(word, pick("k", "", "jwt: ", "Cookie: session=", "token=")), F.concat(F.lit("eyJ"), F.substring(alnum, 1, 20), F.lit("."), F.substring(noise, 4, 30), F.lit("."), F.substring(alnum, 20, 30)), quote, 1),
        (set_to, plain, pick("r2", "", " ", ".", '"', ","), 0),
        (set_to, called, pick("r3", "", ")", '"', "\n"), 0),
        (set_to, F.substring(hexes, 1, 40), quote, 1),
        (F.concat(word, pick("k", "aws_access_key_id", "AWS_ACCESS_KEY_ID", "access_key"), sign, quote), F.concat(F.lit("AKIA"), F.upper(F.concat(F.substring(digits, 1, 5), F.substring(alnum, 3, 11)))), quote, 1),
        (F.concat(word, pick("k", "GITHUB_TOKEN", "token", "Authorization", "clone"), pick("s2", "=", ": ", " ", "://"), quote), F.concat(pick("p", "ghp_", "gho_", "glpat-", "npm_"), F.concat(F.lit("7"), F.substring(alnum, 2, 35))), quote, 1),
        (set_to, F.concat(F.substring(digits, 1, 2), F.substring(noise, 1, 38)), quote, 1),
        (set_to, F.substring(hexes, 5, 32), quote, 1),
        (F.concat(word, pick("k", "Authorization: Bearer ", "bearer ", "auth: ", "-H 'X-Api-Key: ")), F.concat(pick("p", "sk-", "xoxb-", "rk_live_", ""), F.lit("3"), F.substring(alnum, 6, 40)), pick("r", "'", "", " ", "\n"), 1),
        (F.concat(word, pick("k", "commit ", "index ", "sha1:", "revision ", "sha256: ", "md5 ", "checksum = ", "digest: ", "etag=", "")), F.substring(hexes, 9, pick("l", 40, 40, 32, 56).cast("int")), pick("r", " ", ".", "\n", ""), 0),
        (F.concat(word, pick("k", "id ", "uuid: ", "guid=", "", "session ")), F.concat_ws("-", *(F.substring(hexes, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), pick("r", " ", ",", "."), 0),
        (F.concat(word, pick("k", "card ", "order ", "", "phone ", "token ", "number: ", "")), F.substring(digits, 1, pick("l", 16, 16, 18, 20).cast("int")), pick("r", " ", ",", "."), 0),
        (F.concat(word, pick("k", "in ", "see /", "href=\"/", "./", "")), F.concat_ws("/", titled(1), titled(2), F.concat(titled(3), F.substring(digits, 1, 2)), titled(4)), pick("r", ".html", ".py", "/", "\""), 0),
        (F.concat(word, pick("k", "", "name = ", "the ", "type: ")), F.concat(titled(1), pick("j", "_", "", "-"), F.initcap(titled(2)), F.initcap(titled(3)), F.lit("Manager"), F.substring(digits, 1, pick("l", 1, 2, 4).cast("int"))), pick("r", " ", ".", "("), 0),
        (set_to, F.concat(pick("p", "EXAMPLE", "example_", "your_", "dummy-", "xxxxxxxx", "sample"), pick("p2", "KEY", "token_", "secret", "xxxxxx", "key-"), pick("p3", "0123456789", "1234567890", "xxxx0000", "123456abcdef")), quote, 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda i, t: F.coalesce(*(F.when(kind == k, (row[i] if isinstance(row[i], Column) else F.lit(row[i])).cast(t)) for k, row in enumerate(kinds)))
    made = spark.range(0, n, 1, 4).select(choose(0, "string").alias("left"), choose(1, "string").alias("found"), choose(2, "string").alias("right"), choose(3, "double").alias("label"), "id", (F.pmod(F.xxhash64("id", F.lit("case")), F.lit(8)) == 0).alias("loud"))
    up = lambda c: F.when(F.col("loud"), F.upper(c)).otherwise(F.col(c)).alias(c)
    return made.select(up("left"), up("found"), "right", "label", "id")


@dataclass
class Forest:
    """A fitted forest, its trees as one list of nodes: (feature or -1, threshold or share of secrets, left, right)."""

    model: RandomForestClassificationModel
    nodes: list[tuple[int, float, int, int]]
    roots: list[int]
    depth: int

    def score(self, values: Column) -> Column:
        """Mean over the trees of the share of secrets in the leaf. ``values``: the features in an array."""
        numbers = lambda k, kind: F.expr(f"array({', '.join(f'{n[k]!r}{kind}' for n in self.nodes)})")
        feature, limit, left, right = (numbers(k, kind) for k, kind in enumerate(("", "D", "", "")))
        at = lambda a, i: F.get(a, i)

        def step(node: Column, _: Column) -> Column:
            return F.when(at(feature, node) < 0, node).when(at(values, at(feature, node)) <= at(limit, node), at(left, node)).otherwise(at(right, node))

        leaf = lambda root: F.aggregate(F.expr(f"sequence(1, {max(1, self.depth)})"), root, step)
        roots = F.expr(f"array({', '.join(map(str, self.roots))})")
        return F.aggregate(roots, F.lit(0.0), lambda total, root: total + at(limit, leaf(root))) / float(len(self.roots))


def _nodes(node, into: list[tuple[int, float, int, int]]) -> int:
    """Append a tree; gives the place of its root."""
    at = len(into)
    into.append((-1, 0.0, at, at))
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        into[at] = (-1, float(stats[1] / (stats[0] + stats[1])), at, at)
    else:
        split = node.split()
        into[at] = (split.featureIndex(), float(split.threshold()), _nodes(node.leftChild(), into), _nodes(node.rightChild(), into))
    return at


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Fit the forest on labelled findings (left, found, right, label 0 or 1)."""
    rows = findings.select(*(c.cast("double").alias(n) for c, n in zip(features(F.col("left"), F.col("found"), F.col("right")), FEATURES, strict=True)), "label")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    nodes: list[tuple[int, float, int, int]] = []
    roots = [_nodes(t._call_java("rootNode"), nodes) for t in model.trees]
    return Forest(model, nodes, roots, depth)


def default_forest(spark: SparkSession) -> Forest:
    """The forest of the built-in labelled findings."""
    return train(materialize(labelled_findings(spark)))


def _scored(text: Column, forest: Forest) -> Column:
    """array<struct<part, left, found, right, score>>: what stands before each candidate, and the candidate; the last one is empty."""
    parts, found = F.split(text, CANDIDATE, -1), F.concat(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.array(F.lit("")))
    zipped = F.transform(
        F.arrays_zip(parts.alias("part"), found.alias("found"), F.concat(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit(""))).alias("next")),
        lambda z: F.struct(z["part"].alias("part"), F.right(z["part"], F.lit(LEFT)).alias("left"), z["found"].alias("found"), F.left(z["next"], F.lit(RIGHT)).alias("right")),
    )
    seen = F.transform(zipped, lambda z: F.struct(z["part"].alias("part"), z["left"].alias("left"), z["found"].alias("found"), z["right"].alias("right"), F.array(*(c.cast("double") for c in features(z["left"], z["found"], z["right"]))).alias("x")))
    return F.transform(seen, lambda z: F.struct(z["part"].alias("part"), z["left"].alias("left"), z["found"].alias("found"), z["right"].alias("right"), F.when(z["found"] == "", F.lit(0.0)).otherwise(forest.score(z["x"])).alias("score")))


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """One row per candidate in ``docs``: doc_id, start, length, finding_sha256, score, is_secret.

    ``start`` counts code points from 0. A candidate is a secret when the forest gives it
    at least ``threshold``. Secrets themselves are not given out, only their digests.
    Null and empty texts, and texts without candidates, have no rows; repeated rows
    repeat. Other columns are ignored.
    """
    hit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(CANDIDATE))
    sized = hit.select("doc_id", F.transform(_scored(F.col("text"), forest), lambda z: F.struct(F.length(z["part"]).alias("gap"), F.length(z["found"]).alias("length"), F.sha2(z["found"].cast("binary"), 256).alias("finding_sha256"), z["score"].alias("score"))).alias("c"))
    placed = F.aggregate("c", F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("starts")), lambda a, z: F.struct((a["at"] + z["gap"] + z["length"]).alias("at"), F.array_append(a["starts"], a["at"] + z["gap"]).alias("starts")))["starts"]
    rows = sized.select("doc_id", F.explode(F.arrays_zip(placed.alias("start"), F.col("c"))).alias("z")).select("doc_id", "z.start", "z.c.length", "z.c.finding_sha256", "z.c.score")
    return rows.where("length > 0").select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "finding_sha256", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by REDACTED; ``n_chars``, where it is there, follows."""
    text = F.col("text")
    clean = F.array_join(F.transform(_scored(text, forest), lambda z: F.concat(z["part"], F.when(z["score"] >= threshold, F.lit(REDACTED)).otherwise(z["found"]))), "")
    out = docs.withColumn("text", F.when(text.rlike(CANDIDATE), clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out
