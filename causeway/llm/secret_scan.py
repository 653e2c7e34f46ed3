"""Secret scans: candidate strings judged by a random forest trained on labelled findings.

Candidates are parts of blank-delimited strings, of LEAST characters or more, with a digit or a change of case inside.
Strings are split at quotes, commas, semicolons, brackets, ``?``, ``&``, ``|`` and ``#``; each name and value inside (of
JSON, XML, code, query strings, flags) is a part of its own, providers' keys are found anywhere, and a URL's password is a
part. Behind a credential's name a value may be of any length and, if it is quoted, hold any marks; a URL's password needs
no digit either. Short or plain values are masked only behind such a name. Each candidate gets features: length, shares of digits and capitals, runs of one character class for each character, mean log probability
of its character transitions, coverage by dictionary words, its marks of a path, address or URL, and whether the words
beside it (or the name before ``=`` or ``:``) speak of credentials or of checksums and examples, whether it has a provider's
format, a credential's name assigns it, or it is an address or a number. Forests trained on labelled findings reject false
positives; what they take for a secret is replaced by MASK in the text.

Transitions and the dictionary are counted over all documents: a word is in the dictionary if it occurs DICTIONARY
times or more. Forests are fitted on at most about SAMPLE labelled findings, half of them of each label (all of a label
with fewer), drawn by hash and dealt by a fixed rule into two folds, value by value. The forest of each fold judges the
other fold's findings, so no finding is judged by its own label; both judge, on average, what neither was fitted on.
Labelled findings are a parameter (columns value and label); a caller's labels stand whatever the forests say. Without
them, ``format_labels`` labels the candidates whose format settles the matter (known providers' keys, and random strings
assigned to a credential's name, against mail and network addresses, plain numbers and URLs) to train on, and every
candidate, those included, gets the forests' verdict. DataFrame and ML functions only, no Python on the executors.

Edge cases: null and empty texts have no candidates and null stays null; rows that share an id share the findings of
all of them; candidates of one text are distinct values; where only one label occurs there is no forest, and what is
labelled 1 is a secret and nothing else; a finding whose judge would be fitted on fewer than FEWEST values of a label
keeps its own label; an empty table gives an empty result; further columns are ignored by ``scan``
and kept by ``masked``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import WORD, read, register, same, saved, text_or_empty

LEAST = 12
MASK = "[SECRET]"
SAMPLE = 20_000
FEWEST = 4
DICTIONARY = 20
DRAWS = 1 << 50
TREES, DEPTH, PARTS, SEED = 20, 6, 8, 4

# Names that go with credentials, names that go with harmless random strings, and providers' key formats.
CREDENTIAL = "(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
HARMLESS = "(?i)(sha\\d*|md5|checksum|digest|commit|revision|uuid|guid|example|sample|dummy|placeholder)"
_KEYS = ("(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|"
         "xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+)")
PROVIDERS = f"^{_KEYS}$"
PROVIDER_INSIDE = f"(?:(?<![A-Za-z0-9])|(?<=\\\\[nrt])){_KEYS}(?![A-Za-z0-9])"
ADDRESS = "^([^@\\s]+@[A-Za-z0-9.-]+|\\d{1,3}(\\.\\d{1,3}){3}(:\\d+)?|[+\\d][\\d().,:/-]*|(https?:)?//\\S*|\\S+://\\S*)$"
RANDOM = "^(?=.*\\d)[A-Za-z0-9+/_-]{12,}={0,2}$"
MIXED = "[0-9]|[a-z][A-Z]"
# Ends of names that values of any length are assigned to, and the forms of assignment in code, JSON, XML, flags, URLs.
NAME = ("(?i:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|"
        "(?<![A-Za-z])(?:pass|auth)|(?-i:Pass|Auth))\\d*")
PASSWORD = "(?i)(pass(word|wd|phrase)|pwd|secret|(?<![A-Za-z])pass)\\d*$"
ASSIGNED = f"{NAME}[\"'`\\]]*[=:>]"
AHEAD = f"({NAME})(?:[\"'`\\]]*\\s?(?:=>|:=|[=:])[\"'`(\\[{{]*|(?<=(?:^|\\s)--?[A-Za-z0-9_-]{{1,60}}))$"
QUOTED = f"({NAME})[\"'`\\]]*(?:=>|:=|[=:])[\"'`]([^\"'`]+)[\"'`]"
USERINFO = "://[^/?#@:\\s\"'`]*:([^/?#\\s\"'`]+)@"
URL_PASSWORD = "url-password"
INNER = f"[=:]([A-Za-z0-9_.-]{{0,40}}{NAME})[\"'`\\]]*[=:](?![=/])([^\"'\\s=:]+=*)$"
JOINED = "[\"'`](?:=>|:=|[=:])[\"'`]?|(?:=>|:=|[=:])[\"'`]"
WHOLE = f"^[^A-Za-z0-9]*[A-Za-z0-9_.-]{{0,60}}{NAME}(?:=>|:=|[=:])(?![A-Za-z_][A-Za-z0-9_.]*[(\\[{{])(?!\\S*</)[^\\s\"'`,;=:]*[.,;:]*$"
MARKS = "[\\s\"'`,;(){}\\[\\]<>?&|#]+"
#: What stands before a value that is masked only in its place.
LEAD = f"(?:{NAME}[\"'`\\]]*\\s*(?:=>|:=|[=:>])\\s*|{NAME}\\s+|://[^/?#@:\\s\"'`]*:)[^A-Za-z0-9+/\\s]{{0,8}}?"
PLACEHOLDER = "^([$<{%*]|[xX]+$)"
FEATURES = ("length", "digits", "capitals", "runs", "transitions", "coverage", "path", "credential", "harmless", "provider",
            "assigned", "address")


def _random_like(value: Column) -> Column:
    return (F.length(value) >= LEAST) & value.rlike(MIXED)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, value, name, before): distinct candidates of each text; ``name`` is what the value is assigned to,
    ``before`` the two words ahead of its string."""
    words = F.regexp_extract_all(text_or_empty(text_col), F.lit(WORD), F.lit(0))
    ahead = lambda ws, i: F.concat_ws(" ", F.when(i > 1, F.get(ws, i - 2)), F.when(i > 0, F.get(ws, i - 1)))
    named = lambda ws, w, i: ((w.rlike("[=:>].") & w.rlike(f"{ASSIGNED}|{USERINFO}"))
                              | ((i > 0) & F.get(ws, i - 1).rlike("[=:>]$|^--?[A-Za-z]") & ahead(ws, i).rlike(AHEAD)))
    found = F.element_at(F.transform(F.array(words), lambda ws: F.filter(F.transform(
        ws, lambda w, i: F.when(_random_like(w) | named(ws, w, i), F.struct(w.alias("w"), ahead(ws, i).alias("before")))),
        lambda c: c.isNotNull())), 1)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(found)).alias("c")).select("doc_id", "c.*")
    w = F.col("w")
    carried = F.col("before").rlike(AHEAD) & ~w.rlike("^[\"'`]?[A-Za-z_][A-Za-z0-9_.-]*[\"'`]?[=:]")
    rows = rows.withColumn("w", F.when(carried, F.concat(F.regexp_extract("before", AHEAD, 1), F.lit("="), w)).otherwise(w))
    every = lambda pattern, k: F.regexp_extract_all(w, F.lit(pattern), F.lit(k))
    called = lambda name, values: F.transform(values, lambda x: F.struct(F.lit(name).alias("name"), x.alias("value")))
    quoted = F.arrays_zip(every(QUOTED, 1).alias("name"), every(QUOTED, 2).alias("value"))
    rest = w
    for taken in (QUOTED, f"[A-Za-z0-9+.-]*{USERINFO}", PROVIDER_INSIDE):
        rest = F.regexp_replace(rest, taken, " ")
    rest = F.regexp_replace(F.regexp_replace(rest, "<([A-Za-z_][A-Za-z0-9_.-]*)>(?=[^<\\s])", " $1="), JOINED, "=")
    pieces = F.when(rest.rlike(WHOLE), F.array(rest)).otherwise(F.split(rest, MARKS))
    rows = rows.select("doc_id", "before", F.concat(
        quoted, called(URL_PASSWORD, every(USERINFO, 1)), called("", every(PROVIDER_INSIDE, 0))).alias("exact"), pieces.alias("pieces"))
    exact = rows.select("doc_id", "before", F.explode("exact").alias("x")).select("doc_id", "x.value", "x.name", "before")
    core = F.regexp_replace(F.col("piece"), "^[^A-Za-z0-9+/]+|[^A-Za-z0-9=+/_-]+$", "")
    parts = rows.select("doc_id", "before", F.explode(F.array_distinct("pieces")).alias("piece")).select("doc_id", core.alias("core"), "before")
    first = "^([A-Za-z_][A-Za-z0-9_.-]*)[\"'`\\]]*(?:=>|:=|[=:])[\"']?(?!//)([^\"'\\s]+)$"
    part = lambda k, other: (F.when(F.col("core").rlike(INNER), F.regexp_extract("core", INNER, k))
                             .when(F.col("core").rlike(first), F.regexp_extract("core", first, k)).otherwise(other))
    parts = parts.select("doc_id", part(2, F.col("core")).alias("value"), part(1, F.lit("")).alias("name"), "before")
    value, name = F.col("value"), F.col("name")
    return (exact.unionByName(parts).where(~(value.rlike(PLACEHOLDER) & (name.rlike(f"{NAME}$") | (name == URL_PASSWORD))))
            .where(_random_like(value) | (value.rlike(MIXED) & name.rlike(f"{NAME}$"))
                                           | ((name == URL_PASSWORD) & (value != "")))
            .dropDuplicates(["doc_id", "value", "name", "before"]))


def dictionary(docs: DataFrame, text_col: str = "text", least: int = DICTIONARY) -> DataFrame:
    """(word, n): lower-case runs of letters that make up a whole word, marks at its ends aside, in all documents."""
    words = F.explode(F.regexp_extract_all(F.lower(text_or_empty(text_col)), F.lit("(?<![^\\s(\"'])(\\p{L}{3,24})(?![^\\s.,;:!?)\"'])"), F.lit(1)))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _pairs(word: Column) -> Column:
    """Neighbouring characters: letters as they are, digits as 0, all else as #."""
    w = F.regexp_replace(F.regexp_replace(F.lower(word), "[0-9]", "0"), "[^a-z0]", "#")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))


def transitions(words: DataFrame) -> DataFrame:
    """(pair, logp): log probability of the second character after the first, over the dictionary's words. At most
    28 x 28 rows."""
    pairs = words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("c")).agg(F.sum("n").alias("of"))
    return pairs.join(first, F.substring("pair", 1, 1) == F.col("c")).select("pair", F.log((F.col("n") + 0.1) / (F.col("of") + 2.8)).alias("logp"))


def featurise(found: DataFrame, words: DataFrame, chain: DataFrame) -> DataFrame:
    """Distinct (value, name, before) with FEATURES."""
    c = saved(found.select("value", "name", "before").distinct().withColumn("key", F.xxhash64("value", "name", "before")))
    value, size = F.col("value"), F.length("value").cast("double")
    values = c.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("\\p{L}{3,}"), F.lit(0))).alias("word"))
    known = runs.select("word").distinct().join(words.select("word"), "word")
    covered = runs.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    steps = (values.select("value", F.explode(_pairs(value)).alias("pair")).join(chain, "pair", "left")
             .groupBy("value").agg(F.avg(F.coalesce("logp", F.lit(-9.0))).alias("transitions")))
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    says = lambda pattern: F.concat_ws(" ", "name", "before").rlike(pattern).cast("double")
    return (c.join(covered, "value", "left").join(steps, "value", "left").select(
        "value", "name", "before", "key", size.alias("length"), (count("[0-9]") / size).alias("digits"),
        (count("[A-Z]") / size).alias("capitals"), (count("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+") / size).alias("runs"),
        F.coalesce("transitions", F.lit(-9.0)).alias("transitions"),
        (F.coalesce("covered", F.lit(0)) / size).alias("coverage"), count("[/@:.]|%[0-9A-F]{2}").alias("path"),
        says(CREDENTIAL).alias("credential"), says(HARMLESS).alias("harmless"), value.rlike(PROVIDERS).cast("double").alias("provider"),
        (F.col("name").rlike(f"{NAME}$") | (F.col("name") == URL_PASSWORD)).cast("double").alias("assigned"),
        value.rlike(ADDRESS).cast("double").alias("address")))


def format_labels(features: DataFrame) -> DataFrame:
    """(value, label) of the findings that their format settles: 1 a secret, 0 none."""
    said = F.concat_ws(" ", "name", "before")
    value, name = F.col("value"), F.col("name")
    password = name.rlike(PASSWORD) & value.rlike("^(?=.*[0-9])(.*[A-Za-z].*|[0-9]{4,})$") & ~value.rlike("://") & ~said.rlike(HARMLESS)
    label = (F.when(value.rlike(PROVIDERS), 1).when(name.rlike(f"{NAME}$") & value.rlike(PLACEHOLDER), 0)
             .when((name == URL_PASSWORD) | password, 1)
             .when(value.rlike(ADDRESS), F.when(~value.rlike(PROVIDER_INSIDE), 0))
             .when(said.rlike(HARMLESS), 0).when(F.col("value").rlike(RANDOM) & said.rlike(CREDENTIAL), 1))
    return features.select("value", label.alias("label")).where("label IS NOT NULL").distinct()


def classify(features: DataFrame, labelled: DataFrame, sample: int = SAMPLE, trusted: bool = True) -> DataFrame:
    """(value, name, before, label, probability, secret): two forests fitted on labelled findings (value, label), each on
    one fold of the values, judge each other's folds and, on average, all else; ``trusted`` labels stand. Each label is
    drawn up to half of ``sample``, so all rows of a rare one are."""
    # counts, sample and verdicts each join the labels: they are worked out once
    marked = saved(labelled.where("label IN (0, 1)").groupBy("value").agg(F.max("label").cast("double").alias("label")))
    known = features.join(marked, "value", "left").withColumn("of", F.xxhash64("value"))
    train = known.where("label IS NOT NULL")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bound = lambda label: int(DRAWS * min(1.0, sample / 2 / counts.get(label, 1)))
    # a bounded sample: its values are numbered by label, so that each fold gets half of a rare label
    fold = F.dense_rank().over(Window.partitionBy("label").orderBy("of")) % 2
    drawn = saved(train.where(F.pmod("key", F.lit(DRAWS)) < F.when(F.col("label") == 1, bound(1.0)).otherwise(bound(0.0)))
                  .select("key", "of", "label", fold.alias("fold"), *FEATURES))
    n = {(r["fold"], r["label"]): r["n"] for r in drawn.groupBy("fold", "label").agg(F.count_distinct("of").alias("n")).collect()}
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    judged = gather.transform(known.join(F.broadcast(drawn.select("of", "fold").distinct()), "of", "left"))
    p = []
    for judge in (0, 1):
        if min(n.get((judge, 0.0), 0), n.get((judge, 1.0), 0)) < FEWEST:
            p.append(F.lit(None).cast("double"))
            continue
        balance = F.when(F.col("label") == 1, n[judge, 0.0] / n[judge, 1.0]).otherwise(1.0)
        # forests draw their samples by partition: deal the rows by a fixed rule
        dealt = drawn.where(F.col("fold") == judge).withColumn("weight", balance).repartition(PARTS, "key").sortWithinPartitions("key")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED + judge, weightCol="weight",
                                        probabilityCol=f"p{judge}", rawPredictionCol=f"r{judge}", predictionCol=f"c{judge}")
        judged = forest.fit(gather.transform(dealt)).transform(judged)
        p.append(vector_to_array(f"p{judge}")[1])
    both = F.coalesce((p[0] + p[1]) / 2, p[0], p[1])
    verdict = F.when(F.col("fold") == 0, F.coalesce(p[1], "label")).when(F.col("fold") == 1, F.coalesce(p[0], "label")).otherwise(both)
    verdict = F.coalesce("label" if trusted else verdict, verdict, "label", F.lit(0.0))
    return judged.select("value", "name", "before", "label", verdict.alias("probability"), (verdict >= 0.5).alias("secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_candidates, secrets): for each id with a candidate, the values taken for secrets, longest first."""
    found = saved(candidates(docs, id_col, text_col))
    words = saved(dictionary(docs, text_col))
    features = saved(featurise(found, words, saved(transitions(words))))
    judged = saved(classify(features, format_labels(features), trusted=False) if labelled is None else classify(features, labelled))
    taken = found.join(judged.where("secret").select("value", "name", "before", F.lit(True).alias("secret")),
                       ["value", "name", "before"], "left")
    longest = F.sort_array(F.collect_set(F.when(F.col("secret"), F.struct(F.length("value").alias("n"), "value"))), asc=False)
    return (taken.groupBy("doc_id").agg(F.count_distinct("value").cast("long").alias("n_candidates"), longest.alias("s"))
            .select("doc_id", "n_candidates", F.transform("s", lambda x: x["value"]).alias("secrets")))


def masked(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
           report: bool = False) -> DataFrame:
    """The documents with all their columns, every secret in the text replaced by MASK; with ``report`` also
    n_candidates and n_secrets."""
    hits = scan(docs, labelled, id_col, text_col).toDF("_scan_id", "_scan_candidates", "_scan_secrets")
    joined = docs.join(hits, same(docs[id_col], F.col("_scan_id")), "left")
    quoted = lambda s: F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    in_place = lambda t, s: F.regexp_replace(t, F.concat(F.lit(f"({LEAD})"), quoted(s), F.lit("(?![A-Za-z0-9])")), F.lit(f"$1{MASK}"))
    hidden = F.aggregate("_scan_secrets", docs[text_col], lambda t, s: F.when(_random_like(s), F.replace(t, s, F.lit(MASK)))
                         .otherwise(in_place(t, s)))
    text = F.when(F.size("_scan_secrets") > 0, hidden).otherwise(docs[text_col]).alias(text_col)
    more = [F.coalesce("_scan_candidates", F.lit(0)).cast("long").alias("n_candidates"),
            F.coalesce(F.size("_scan_secrets"), F.lit(0)).cast("long").alias("n_secrets")] if report else []
    return joined.select(*[text if c == text_col else docs[c] for c in docs.columns], *more)


@register("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of every document, and a digest of its masked text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = masked(docs, report=True)
    return out.select("doc_id", "n_candidates", "n_secrets", F.length(text_or_empty()).cast("long").alias("masked_chars"),
                      F.sha2(text_or_empty(), 256).alias("masked_sha256"))
