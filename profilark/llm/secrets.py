"""Secrets in texts: a random forest removes false positives; DataFrame functions only.

Candidates are the longest runs of ``[A-Za-z0-9_+/-]`` of 16 characters or more (with up to two ``=``
of padding), and after an assignment to a secret word quoted values of 6 to 128 characters of any kind but
white space and unquoted ones of 8 or more.  Each is described
by its length, its character transitions (class changes, and how English its letter pairs are),
dictionary coverage, shape, the path of its text and the words beside it.  A random forest is grown in
numpy on labelled findings (a fixed table that goes through the same SQL features: candidates from
real source files, lines written by hand, and generated ones), written out as one CASE expression per tree, and run inside the scan.  A candidate is a secret when the mean
vote is 0.5 or more.

Definitions.  Null and short texts have no candidates.  A null path is an empty one.  Candidates are
numbered from 0 in text order.  Ids may be null or repeat.
"""

from __future__ import annotations

import base64
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilark.llm.columns import named
from profilark.llm.findings import NOT_SECRET, SECRET

SECRET_WORDS = "token|secret|passw(?:or)?d|passwd|pwd|pass|api_?key|apikey|key|auth|authorization|bearer|credentials?|private|access|signature|client_?secret|aws|webhook"
OTHER_WORDS = "sha(?:1|256|512)?|commit|hash|md5|checksum|digest|uuid|guid|example|integrity|image|revision|version|etag|file|path|class|function|import|package|href|src|isbn|serial|build|branch|url"
PREFIXES = "AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|npm_|dop_v1_|eyJ"
_NAMED = rf"(?i:{SECRET_WORDS})"
RUN = (
    # a value in quotes, then a bare one, each assigned to a secret word
    rf"(?<=[\"'`])(?<={_NAMED}[\"'`]?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"'`])[^\s\"'`]{{6,128}}(?=[\"'`])"
    rf"|(?<==)(?<={_NAMED}=)[^\s\"'`&;,<>(){{}}\[\]]{{8,}}"
    r"|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
)
#: Words and stems of at least three letters; longer ones first, as the first that fits is taken.
DICTIONARY = sorted(
    set(
        "able about access account action active address after again agent album alert all also always amount and another answer any application apply area array article assert async attribute audio auto back base batch because been before best between block board body book boolean border both bottom box branch browser buffer build button cache call camera can cancel card case center change channel character chart check child city class clean click client clone close cloud code collection color column command comment common company compare complete component condition config connect console constant contact container content context control controller convert copy core count country create current custom data database date day debug default define delete delta depend description design detail device different digital dimension direct directory disable display distance document domain double down download draft draw driver drop dynamic each edge edit element email empty enable encode end engine english enter entity entry enum environment equal error event every exact example exception exclude execute exist exit expand expect export express extend external extra factory fail false family fast feature fetch field figure file filter final find first fixed flag float folder follow font foot force form format forward found frame free from full function game general generate get global good grand graph great green grid group guide half handle hard hash have head header heart height hello help here hidden high history home host hour house how html http icon identifier image impl implement import include index info information init initialize inner input insert inside install instance integer interface internal into item iterator java join json just keep kernel keyboard kind know label language large last later layer layout lead learn left length letter level library license life light like limit line link list listener little live load local location lock log login long look loop machine main make manage manager many map mark market match math matrix maximum mean media member memory menu message meta method middle mime minimum minute mobile mode model modern module moment money month more most mouse move movie multi music must name native navigate need nested network never news next night node none normal not note notification null number object observer offset old only open operation operator option order original other out outer output over override owner package page paint pair panel parameter parent parse part partial partition party pass patch path pattern people percent permission person phone photo pixel place plain plan plane platform play player please plugin point policy pool popular port position possible post power prefix present press preview previous price primary print priority private problem process processor produce product profile program project promise property protocol provide provider proxy public publish pull push python quality query question queue quick random range rank rate read reader ready real reason receive record red reduce reference region register relation release remote remove render repeat replace report repository request require reset resolve resource response rest result return reverse right role root round route row rule run sample save scale scan schedule schema school science scope score screen script scroll search second section secure security select self send sentence sequence serial server service session set setting shape share shared shell short show side sign signal simple single site size sleep slice small smart social socket soft software some sort sound source space span special speed split spring stack stage standard star start state static station status step stop storage store story strategy stream street string strong structure student style submit success suffix super support switch symbol sync system table target task team template temp term test text than thank that the their them then there thing think this thread three through time timeout title today toggle token tool top total touch trace track train transaction transfer transform transition translate tree trigger true try type under union unique unit universe unknown update upload upper user using util utility valid validate value variable vector version vertical video view virtual visible wait walk want warning watch water web week weight well what when where which while white wide width will window with within word work worker world would wrapper write writer year yellow yes you zero zone"
        " tion ment ness ing the and ent ion her for tha nth int ere ter est ers ati hat ate all eth hes ver his ith oft sth oth res ont ich den ein sch die und der nde gen que des les eur ans ait las los con por para ado ien".split()
    ),
    key=lambda w: (-len(w), w),
)
COMMON_PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ll ri ro io la ne el om ic li ch us co me ce ns no ec ma un di ss ta rs pe so be em ac ut wh ly ie ul ge tr us ue qu ai am ad ia na sh il oi au ei"

FEATURES = ["length", "digits", "uppers", "marks", "changes", "letters_run", "english", "covered", "distinct", "prefixed", "secret_before", "other_before", "assigned", "quoted", "secret_after", "path_plain", "path_secret", "hex"]


def features(value: str, before: str, after: str, path: str) -> list[Column]:
    """The features of columns of these names; ``before`` and ``after`` are the text beside the candidate."""
    v, low = F.col(value), F.lower(F.col(value))
    n = F.length(v).cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    without = lambda c, p: F.length(F.regexp_replace(c, p, ""))
    near = F.regexp_extract(F.lower(F.col(before)), r"([a-z0-9_.-]+)[^a-z0-9_]*([a-z0-9_-]*)[^a-z0-9_]*$", 0)
    pairs = "|".join(f"{p[0]}(?={p[1]})" for p in COMMON_PAIRS.split())
    letters = F.greatest(F.regexp_count(low, F.lit("[a-z](?=[a-z])")).cast("double"), F.lit(1.0))
    return [
        n.alias("length"),
        (count("[0-9]") / n).alias("digits"),
        (count("[A-Z]") / n).alias("uppers"),
        (count("[_+/=-]") / n).alias("marks"),
        (count("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])") / n).alias("changes"),
        F.array_max(F.transform(F.split(low, "[^a-z]+"), F.length)).cast("double").alias("letters_run"),
        (F.regexp_count(low, F.lit(pairs)).cast("double") / letters).alias("english"),
        ((n - without(low, "|".join(DICTIONARY))) / n).alias("covered"),
        (F.size(F.array_distinct(F.split(v, ""))).cast("double") / n).alias("distinct"),
        F.rlike(v, F.lit(f"^(?:{PREFIXES})")).cast("double").alias("prefixed"),
        F.rlike(near, F.lit(rf"(?:^|[^a-z])(?:[a-z]+_)?(?:{SECRET_WORDS})(?:[^a-z]|$)")).cast("double").alias("secret_before"),
        F.rlike(near, F.lit(rf"(?:^|[^a-z])(?:[a-z]+_)?(?:{OTHER_WORDS})(?:[^a-z]|$)")).cast("double").alias("other_before"),
        F.rlike(F.col(before), F.lit(r"[=:]\s*[\"'`]?$|(?i:bearer|basic)\s$")).cast("double").alias("assigned"),
        F.rlike(F.concat(F.right(F.col(before), F.lit(1)), F.left(F.col(after), F.lit(1))), F.lit("^([\"'`])\\1$")).cast("double").alias("quoted"),
        F.rlike(F.lower(F.col(after)), F.lit(rf"^[^a-z]*(?:{SECRET_WORDS})(?:[^a-z]|$)")).cast("double").alias("secret_after"),
        F.rlike(F.lower(F.col(path)), F.lit(r"test|example|sample|fixture|mock|docs?/|readme|\.md|\.lock|vendor|node_modules|dist/|\.min\.")).cast("double").alias("path_plain"),
        F.rlike(F.lower(F.col(path)), F.lit(r"\.env|\.pem|\.key|secret|credential|config|settings|\.ya?ml|\.ini|\.properties|\.tf")).cast("double").alias("path_secret"),
        F.rlike(v, F.lit("^[0-9a-f]+$|^[0-9A-F]+$")).cast("double").alias("hex"),
    ]


def findings(seed: int = 7, each: int = 40) -> list[tuple[str, str, str, str, int]]:
    """The labelled table: (value, text before, text after, path, is a secret)."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    words = [w for w in DICTIONARY if len(w) > 3]
    names = ["token", "secret", "api_key", "password", "auth_token", "client_secret", "access_key", "private_key", "API_KEY", "SECRET_KEY"]
    paths = ["src1", "src7", "", "app/config.yml", ".env", "deploy/settings.py", "src/main.py", "lib/util.js", "notes.txt"]
    plain = ["src1", "src3", "", "tests/test_app.py", "README.md", "docs/guide.md", "src/main.py", "lib/util.js", "package-lock.json", "app/config.yml"]
    prose = lambda: " ".join(r.choice(words) for _ in range(4))
    camel = lambda: "".join(w.capitalize() if k else w for k, w in enumerate(r.sample(words, 4)))
    syllable = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "sch", "ein", "ung", "keit", "que", "ment", "tion", "asa", "cion", "eau", "ble", "ing"]) for _ in range(r.randint(7, 11)))
    out = []
    for _ in range(each):
        name = r.choice(names)
        sep, q = r.choice([' = "', '="', "='", ": ", " = ", '": "']), r.choice(['"', "'", "", " "])
        close = '"' if sep.endswith('"') else "'" if sep.endswith("'") else q.strip("\"'")
        out += [
            (pick(hexa, r.choice([32, 40, 40, 64])), f"{prose()} {name}{sep}", f"{close} {prose()}", r.choice(paths), 1),
            ("AKIA" + pick(upper, 16), r.choice([f"{prose()} ", f"{name}{sep}", "aws "]), f"{close if r.random() < 0.3 else ''} {prose()}", r.choice(paths), 1),
            (r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "npm_"]) + pick(alnum, 36), r.choice([f"{prose()} ", f"{name}{sep}"]), f"{close} {prose()}", r.choice(paths), 1),
            (pick(alnum + "+/", 40), f"{prose()} {name}{sep}", f"{close}", r.choice(paths), 1),
            (pick(alnum, r.randint(20, 44)), f"{prose()} Authorization: Bearer ", f" {prose()}", r.choice(paths), 1),
            (pick(alnum + "-_", r.randint(20, 32)), f"{name}{sep}", f"{close} {prose()}", r.choice(paths), 1),
            (syllable(), f"{prose()} ", f", {prose()}", r.choice(plain), 0),
            (syllable().capitalize(), f"{prose()}. ", f" {prose()}", r.choice(plain), 0),
            (camel(), r.choice([f"{prose()} ", "function ", "class ", "import ", "key: "]), f"({prose()}", r.choice(plain), 0),
            ("_".join(r.sample(words, 4)), r.choice([f"{prose()} ", "token = ", "self."]), f" {prose()}", r.choice(plain), 0),
            ("-".join(r.sample(words, 4)), r.choice([f"{prose()} ", 'class="', "secret: "]), f'" {prose()}', r.choice(plain), 0),
            ("/".join(r.sample(words, 4)), r.choice([f"{prose()} ", "path = ", "/"]), f" {prose()}", r.choice(plain), 0),
            (pick(hexa, r.choice([40, 64, 32])), r.choice(["commit ", "sha256: ", "checksum = ", "md5: ", "image@sha256:", "revision "]), f" {prose()}", r.choice(plain), 0),
            ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice(["uuid = ", "id: ", f"{prose()} "]), f" {prose()}", r.choice(plain), 0),
            (pick("0123456789", r.choice([16, 18, 20])), f"{prose()} ", f" {prose()}", r.choice(plain), 0),
            (r.choice("=-_/+") * r.randint(16, 60), "\n", "\n", r.choice(plain), 0),
            (base64.b64encode(" ".join(r.sample(words, 12)).encode()).decode(), r.choice(["base64,", "integrity=sha512-"]), f'" {prose()}', r.choice(plain), 0),
            (pick(hexa, r.choice([40, 64])), f"{prose()} ", f" {prose()}", r.choice(plain), 0),
            ("x" * r.randint(16, 40), f"{name}{sep}", f"{close}", r.choice(plain), 0),
            ("your_" + "_".join(r.sample(words, 2)) + "_here", f"{name}{sep}", f"{close}", r.choice(plain), 0),
        ]
    # assignments without quotes, and short values; drawn apart from the rows above
    s = random.Random(seed + 1000)
    draw = lambda chars, n: "".join(s.choice(chars) for _ in range(n))
    text = lambda: " ".join(s.choice(words) for _ in range(4))
    short = []
    for _ in range(each):
        name, marks = s.choice(names), string.ascii_letters + string.digits + "!$%&*@#?"
        short += [
            (s.choice(["ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "npm_"]) + draw(alnum, 36), f"{text()}\n{name}=", f"\n{text()}", s.choice(paths), 1),
            (draw(hexa, s.choice([32, 40, 64])), f"{text()}{s.choice('?&')}access_token=", f"{s.choice(['&', ' '])}{text()}", s.choice(paths), 1),
            (draw(alnum, s.randint(16, 40)), f"\n{name}=", "\n", s.choice(paths), 1),
            (draw(marks, s.randint(8, 15)), f"{text()} {name}{s.choice([' = ', '=', ': '])}\"", f'" {text()}', s.choice(paths), 1),
            (draw(marks.replace("&", ""), s.randint(8, 15)), f"\n{name}=", f"\n{text()}", s.choice(paths), 1),
            ("".join(s.sample(words, 2))[:15], f'{text()} {name} = "', f'" {text()}', s.choice(plain), 0),
            ("_".join(s.sample(words, 2)), f"\n{name}=", f"\n{text()}", s.choice(plain), 0),
            (syllable().upper(), f"{text()} ", f" {text()}", s.choice(plain), 0),
            ("_".join(s.sample(words, 3)).upper(), s.choice(["\n", f"{text()} "]), s.choice(["", "=1", " = "]), s.choice(paths), 0),
            (s.choice(["*", "x", "."]) * s.randint(8, 15), f'{name} = "', '"', s.choice(plain), 0),
            (draw(hexa, s.choice([40, 64])), f"{s.choice(['commit', 'sha256', 'checksum', 'etag'])}=", f" {text()}", s.choice(plain), 0),
        ]
    return [row for row in out if len(row[0]) >= 16] + [row for row in short if len(row[0]) >= 8]


def labelled_table(seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """The findings that the forest learns: those of ``findings`` and the generated ones."""
    return [*findings(seed), *((*row, 0) for row in NOT_SECRET), *((*row, 1) for row in SECRET for _ in range(3))]


class Forest:
    """Gini trees on bootstrap samples with random feature subsets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 7, seed: int = 5):
        r = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = r.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], depth, r))

    def _grow(self, x, y, depth, r):
        p = float(y.mean())
        best = None
        if depth and 0 < p < 1 and len(y) >= 4:
            for f in r.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5) + 1), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                xs, ys = x[order, f], y[order]
                edge = np.flatnonzero(xs[1:] > xs[:-1])
                if len(edge):
                    n, one = edge + 1, np.cumsum(ys)[edge]
                    a, b = one / n, (ys.sum() - one) / (len(ys) - n)
                    cost = n * a * (1 - a) + (len(ys) - n) * b * (1 - b)
                    k = int(cost.argmin())
                    if best is None or cost[k] < best[0]:
                        best = (float(cost[k]), int(f), float(xs[edge[k]] + xs[edge[k] + 1]) / 2)
        if best is None or best[0] >= len(y) * p * (1 - p) - 1e-9:
            return round(p, 6)
        _, f, cut = best
        low = x[:, f] <= cut
        return f, round(cut, 6), self._grow(x[low], y[low], depth - 1, r), self._grow(x[~low], y[~low], depth - 1, r)

    def _walk(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.mean([self._walk(t, row) for t in self.trees]) for row in x])

    def sql(self) -> str:
        """The mean vote over columns named as ``FEATURES``."""

        def case(t):
            return f"CASE WHEN {FEATURES[t[0]]} <= {t[1]!r}D THEN {case(t[2])} ELSE {case(t[3])} END" if isinstance(t, tuple) else f"{t!r}D"

        return "(" + " + ".join(case(t) for t in self.trees) + f") / {len(self.trees)}.0D"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def labelled_features(spark: SparkSession, rows: list[tuple[str, str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features (through the same SQL) and labels of labelled findings; a bounded table."""
    values = ", ".join("(" + ", ".join([*map(_literal, row[:4]), str(row[4])]) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(value, before, after, path, label)")
    got = np.array([list(map(float, x)) for x in table.select(*features("value", "before", "after", "path"), "label").collect()])
    return got[:, :-1], got[:, -1]


class SecretScan:
    """``candidates`` with features; ``run`` returns the secrets only."""

    def __init__(self, labelled: list[tuple[str, str, str, str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source"):
        self.labelled, self.id_col, self.text_col, self.path_col = labelled, id_col, text_col, path_col

    def candidates(self, docs: DataFrame) -> DataFrame:
        """``id, number, value, before, after, path`` of every candidate."""
        text = F.col(self.text_col).cast("string")
        # the text between candidates: one piece more than there are candidates
        between = F.transform(F.split(text, RUN, -1), lambda p: F.struct(F.right(p, F.lit(96)).alias("end"), F.left(p, F.lit(48)).alias("start")))
        rows = docs.select(F.col(self.id_col).alias("id"), F.coalesce(F.col(self.path_col).cast("string"), F.lit("")).alias("path"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("found"), between.alias("between"))
        rows = rows.where(F.size("found") > 0)
        start = F.transform(F.slice("between", F.lit(2), F.size("found")), lambda p: p["start"])
        # a candidate just before this one is part of the text before it: it may be its name
        ends = F.transform("between", lambda p, i: F.when(i > 0, F.right(F.concat(F.get("found", i - 1), p["end"]), F.lit(96))).otherwise(p["end"]))
        zipped = F.arrays_zip(F.col("found"), ends.alias("ends"), start.alias("starts"))
        rows = rows.select("id", "path", F.posexplode(zipped).alias("number", "z")).where("z.found is not null")
        return rows.select("id", "number", F.col("z.found").alias("value"), F.col("z.ends").alias("before"), F.col("z.starts").alias("after"), "path")

    def run(self, docs: DataFrame) -> DataFrame:
        """``id, number, value, word_before, probability`` of every secret."""
        forest = Forest(*labelled_features(docs.sparkSession, self.labelled or labelled_table()))
        rows = self.candidates(docs).select("id", "number", "value", "before", *features("value", "before", "after", "path"))
        rows = rows.withColumn("probability", F.round(F.expr(forest.sql()), 6)).where("probability >= 0.5")
        word = F.regexp_extract("before", r"([A-Za-z_][A-Za-z0-9_-]*)[^A-Za-z0-9_]*$", 1)
        return rows.select(F.col("id").alias(self.id_col), F.col("number").cast("long").alias("number"), "value", word.alias("word_before"), "probability")
