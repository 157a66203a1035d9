"""Secret scans with a random forest, as Spark expressions.

Candidates are all runs of 12 key-like characters or more, long words among
them; published key formats on their own, wherever they stand; and the whole
values behind a credential's name (``password = "x"``) or in a URL
(``://user:x@``), of any length. A value in quotes is all up to the same quote
on its line, blanks included; one without quotes ends at white space or the next
``,name=``, closing signs left out. A random forest tells secrets from false positives by the candidate's
length, its character transitions, its coverage by dictionary words, the path
it stands in and the words next to it. The forest is fitted by Spark ML on
labelled findings (the positive ones of all documents, a sample of the others) and then written as one SQL expression over the features, so
a text is scanned in its own row: no join, no shuffle, no Python.

Labelled findings can be any table of candidates with a label. Where there is
none, ``labelled_findings`` makes it: candidates of published key formats, and
values assigned to the name of a credential, are positive; assigned values made
of dictionary words, placeholders or code, and all other candidates, negative.
Runs that look like a key but stand alone, in a value or round a format have no
label: the forest judges them without having been taught either. Key-like values
are taught a second time without what stands next to them.

A key or word inside a value is a finding of its own only if the value is none.

Defined results: a null text has no candidates and stays null when redacted;
without labelled findings of both kinds every candidate has the one label there
is (none: 0); equal candidates are equal findings, each in its place; repeated
rows and all columns stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import col, free_prefix
from assaykit.session import stored

#: Bound of the fit: about so many documents (by a hash of their id and text) give the negative findings.
TRAIN_DOCS = 12_000
#: Positive findings come from all documents: every different one of a kind (a format, a credential's name), about so many of a
#: kind at most (by a hash). A kind with fewer than the second number is repeated up to it, so that each tree sees it.
PER_KIND, LEAST_OF_KIND = 2000, 40
#: The dictionary holds the most frequent words of all documents by length, the transitions those of all its words.
DICTIONARY, LENGTHS, PAIRS, NEIGHBOURS = 300, range(3, 13), 250, 100
TREES, TREE_DEPTH, LEAST_SCORE = 15, 5, 0.5
MASK = "[SECRET]"

#: Published formats of keys, and names that credentials are assigned to.
KEY_FORMATS = (r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}",
               r"AIza[0-9A-Za-z_-]{35}", r"sk-[A-Za-z0-9_-]{20,}", r"github_pat_[A-Za-z0-9_]{22,}",
               r"[rs]k_live_[A-Za-z0-9]{16,}", r"glpat-[A-Za-z0-9_-]{20,}", r"eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+){0,2}")
CREDENTIALS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "credential", "auth")

#: Fixed words of placeholders and code, as whole parts of a value, and signs of code and of templates.
PLACEHOLDERS = ("your", "my", "some", "example", "sample", "dummy", "test", "fake", "placeholder", "change", "changeme", "insert", "enter",
                "here", "todo", "redacted", "xxx", "xxxx", "null", "none", "nil", "true", "false", "undefined", "value", "string", "key",
                "api", "access", "user", "name", "the", "get", "set", "env", "self", "this", "config", "settings", "os", "environ")
_CODE = r"^(?:<.*|[$%#]?[{(].*|\$[A-Za-z_]+|\*+|[xX.*-]+|[A-Za-z_][A-Za-z_.]*[(\[].*)$"

_RUN = r"[A-Za-z0-9+/_-]{12,}"


def _q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NAMES = "(?i:" + "|".join(CREDENTIALS) + ")"
_ASSIGNED = "(" + "|".join(CREDENTIALS) + r")[\"']?\s*[:=]+\s*[\"']?$"

#: Formats on their own; a name with its sign; a value without quotes, and what is left out at its end; user and password of a URL.
_FORMATS = "(?<![A-Za-z0-9])(?:" + "|".join(KEY_FORMATS) + ")"
_MARK = _NAMES + r"[\"']?[:=]+[\"']?"
_BARE = r"(?:(?![,;&][\w-]+[:=]|[\"'](?:[,;:)\]}>\s]|$))\S)+"
_CLOSING = r"[\"'`,;.)\]}>]+$"
_USER = r"://[^\s/:@]*:"
_URL = _USER + r"(?!\d+[/?#])\S+?(?=@[\w.\[\]-]+(?:[:/?#,;)\"'\s]|$))"

#: Blanks and tabs inside a quoted value stand as these two signs while a text is in pieces, so the value is one piece.
#: A text that holds one of them itself is cut at all white space.
_HELD = "\ue000\ue001"


def _held(text: str, sign: str, quote: str, held: str) -> str:
    """SQL of a text whose blanks (``sign``) between the quotes of a credential's value are ``held``."""
    open_ = _NAMES + rf"[\"']?\s*[:=]+\s*{quote}"
    inside = rf"(?:{open_}|\G(?<!^))[^{quote}\r\n{sign}]*"
    return f"regexp_replace({text}, {_q(rf'({inside}){sign}(?=[^{quote}\r\n]*{quote})')}, {_q('$1' + held)})"


def _pieces(text: str) -> str:
    """SQL of the pieces of a text column: a word, or a value in quotes, and the white space behind it."""
    name = "`" + text.replace("`", "``") + "`"
    held = name
    for sign, stands in zip((" ", "\t"), _HELD):
        for quote in "\"'":
            held = _held(held, sign, quote, stands)
    quoted = _q(r"[:=]\s*[\"']")
    whole = f"if({name} RLIKE {quoted} AND NOT {name} RLIKE {_q('[' + _HELD + ']')}, {held}, coalesce({name}, ''))"
    return f"split({whole}, {_q(r'(?<=\s)(?=\S)')}, -1)"


def _own(text: str) -> str:
    """SQL of whether a text holds one of the two signs itself. It reads the whole text: ask once a row, not once a finding."""
    return f"`{text.replace('`', '``')}` RLIKE {_q('[' + _HELD + ']')}"


def _given(sql: str, own: str) -> str:
    """SQL of a string made of a text's pieces with the text's own blanks; ``own``: SQL of ``_own`` of the text."""
    return f"if({own}, {sql}, replace(replace({sql}, {_q(_HELD[0])}, ' '), {_q(_HELD[1])}, {_q(chr(9))}))"


#: Characters of its own piece that count as what stands before or behind a candidate.
_NEAR = 80


#: SQL: a string holds one of the signs that stand between a name and its value.
_SIGNS = "(contains({0}, '=') OR contains({0}, ':'))"


#: SQL: the piece p can hold a candidate by itself.
_ALONE = f"octet_length(p) >= 12 AND length(p) >= 12 OR {_SIGNS.format('p')}"


def _each(pieces: str, made: str) -> str:
    """SQL of ``made``, of the piece p at place i, for each piece that can hold a candidate: one with signs, a long one, or the one
    behind a piece with signs. Most can't, and nothing but ``_ALONE`` is asked of them."""
    alone = f"array_remove(transform({pieces}, (p, i) -> if({_ALONE}, i, -1)), -1)"
    behind = f"filter(o, i -> i + 1 < size({pieces}) AND {_SIGNS.format(f'get({pieces}, i)')})"
    places = f"sort_array(array_union(o, transform({behind}, i -> i + 1)))"
    of = f"transform({places}, i -> element_at(transform(array(get({pieces}, i)), p -> {made}), 1))"
    return f"element_at(transform(array({alone}), o -> {of}), 1)"


def _found(pieces: str) -> str:
    """SQL of the candidates of such a piece p at place i: how found, r with h directly before it, b and f before and behind."""
    prev = f"concat(coalesce(get({pieces}, i - 2), ''), coalesce(get({pieces}, i - 1), ''))"
    none = "cast(array() AS array<struct<how: string, h: string, w: string>>)"
    mark = "struct({how} AS how, {h} AS h, {w} AS w)"
    marks = "concat(" + ", ".join([
        f"if({_SIGNS.format('p')}, transform(regexp_extract_all(p, {_q(_MARK + r'(?:(?<=[\"])[^\"\s]+|(?<=' + chr(39) + r')[^' + chr(39) + r'\s]+|(?<![\"' + chr(39) + '])' + _BARE + ')')}, 0), "
        f"m -> {mark.format(how=_q('value'), h=f'regexp_extract(m, {_q("^" + _MARK)}, 0)', w='m')}), {none})",
        f"if({_SIGNS.format('v')} AND v RLIKE {_q(_NAMES + r'[\"' + chr(39) + r']?\s*[:=]+\s+$')}, "
        f"array({mark.format(how=_q('value'), h=f'regexp_extract(p, {_q("^[" + chr(34) + chr(39) + "]?")}, 0)', w='p')}), {none})",
        f"if((p LIKE '=%' OR p LIKE ':%') AND p RLIKE {_q(r'^[:=]+[^\s:=]')} AND v RLIKE {_q(_NAMES + r'[\"' + chr(39) + r']?\s+$')}, "
        f"array({mark.format(how=_q('value'), h=f'regexp_extract(p, {_q("^[:=]+[" + chr(34) + chr(39) + "]?")}, 0)', w='p')}), {none})",
        f"if(contains(p, '://') AND contains(p, '@'), transform(regexp_extract_all(p, {_q(_URL)}, 0), "
        f"m -> {mark.format(how=_q('url'), h=f'regexp_extract(m, {_q("^" + _USER)}, 0)', w='m')}), {none})"]) + ")"
    rest = "substr(x.w, length(x.h) + 1)"
    value = (f"CASE WHEN x.how = 'url' THEN {rest} WHEN x.h LIKE '%\"' THEN regexp_extract({rest}, {_q(r'^[^\"\s]+')}, 0) "
             f"WHEN x.h LIKE {_q('%' + chr(39))} THEN regexp_extract({rest}, {_q('^[^' + chr(39) + r'\s]+')}, 0) "
             f"ELSE regexp_replace(regexp_extract({rest}, {_q('^' + _BARE)}, 0), {_q(_CLOSING)}, '') END")
    plain = "cast(array() AS array<struct<how: string, h: string, r: string>>)"
    values = (f"if({_SIGNS.format('p')} OR {_SIGNS.format('v')}, "
              f"filter(transform({marks}, x -> struct(x.how AS how, x.h AS h, {value} AS r)), x -> x.r != ''), {plain})")
    formats = (f"transform(filter(regexp_extract_all(p, {_q(_FORMATS)}, 0), r -> NOT exists(y, x -> x.r = r)), "
               f"r -> struct('format' AS how, '' AS h, r AS r))")
    runs = (f"transform(filter(regexp_extract_all(regexp_replace(p, {_q(_FORMATS)}, ' '), {_q(_RUN)}, 0), "
            f"r -> NOT exists(y, x -> x.r = r)), r -> struct(if(exists(y, x -> contains(x.r, r)), 'inner', 'run') AS how, '' AS h, r AS r))")
    # All formats hold a run.
    keys = f"if(length(p) >= 12 AND p RLIKE {_q(_RUN)}, concat({formats}, {runs}), {plain})"
    head = "substring_index(p, concat(x.h, x.r), 1)"
    behind = f"substr(p, length({head}) + length(x.h) + length(x.r) + 1, {_NEAR})"
    near = (f"x -> struct(x.how AS how, x.h AS h, x.r AS r, lower(concat(v, right({head}, {_NEAR}), x.h)) AS b, "
            f"lower(concat({behind}, coalesce(get({pieces}, i + 1), ''))) AS f)")
    return f"element_at(transform(array({prev}), v -> element_at(transform(array({values}), y -> transform(concat(y, {keys}), {near})), 1)), 1)"


def _word(side: str, which: str) -> str:
    """SQL of the word next to a candidate: the last one before it, or the first one behind it ('' where there is none)."""
    # The last word is looked for from the end: from the start, a long run is read again from each of its letters.
    first = f"regexp_extract({f'reverse({side})' if which == 'before' else side}, {_q(r'^[^\p{L}_]*([\p{L}_]+)')}, 1)"
    return f"reverse({first})" if which == "before" else first


def _plain(run: str, words: dict[int, list[str]]) -> str:
    """SQL of the share of a candidate's parts that are words of the dictionary, of placeholders or of code."""
    known = ", ".join(map(_q, sorted({w for some in words.values() for w in some} | {*PLACEHOLDERS, *CREDENTIALS})))
    parts = f"filter(split(lower({run}), {_q(r'[^\p{L}0-9]+')}), w -> w != '')"
    share = f"if(size(k) = 0, 0D, size(filter(k, w -> w IN ({known}))) / size(k))"
    return f"element_at(transform(array({parts}), k -> {share}), 1)"


def _starts(words: list[str]) -> str:
    """Regular expression that matches, without a length, at each place where one of the words starts: a tree of their letters."""
    def tree(some: list[str]) -> str:
        if "" in some:  # a shorter word says it all
            return ""
        heads: dict[str, list[str]] = {}
        for w in some:
            heads.setdefault(w[0], []).append(w[1:])
        last = [c for c, rest in heads.items() if "" in rest]
        parts = ["[" + "".join(last) + "]" if len(last) > 1 else last[0]] if last else []
        parts += [c + tree(rest) for c, rest in heads.items() if c not in last]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return "(?=" + tree(sorted(words)) + ")"


@dataclass
class Scanner:
    words: dict[int, list[str]] = field(default_factory=dict)  # dictionary, by length
    pairs: list[str] = field(default_factory=list)             # common transitions
    near: dict[str, list[str]] = field(default_factory=dict)   # before, behind: words next to secrets
    forest: str = "0.0D"                                       # SQL over the fields of c

    def features(self, x: str = "x") -> dict[str, str]:
        """SQL of each feature, over the candidate x (r, with b before and f behind it) of the piece p."""
        low, n = f"lower({x}.r)", f"length({x}.r)"
        known = [w for some in self.words.values() for w in some]
        covered = f"regexp_count({low}, {_q(_starts(known))})" if known else "0"
        common = f"regexp_count({low}, {_q(_starts(self.pairs))})" if self.pairs else "0"

        def listed(side: str) -> str:
            return ", ".join(map(_q, self.near.get(side) or [" "]))

        return {
            "size": f"cast({n} AS double)",
            "digits": f"regexp_count({x}.r, '[0-9]') / {n}",
            "capitals": f"regexp_count({x}.r, '[A-Z]') / {n}",
            "turns": f"regexp_count({x}.r, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])') / {n}",
            "common": f"if({n} > 1, {common} / ({n} - 1), 0D)",
            "covered": f"if({n} > 2, {covered} / ({n} - 2), 0D)",
            "signs": f"length(regexp_replace({x}.r, '[A-Za-z0-9]+', '')) / {n}",
            "user": f"cast(if({x}.f LIKE '@%' AND {x}.b RLIKE {_q(_USER + '$')}, 1, 0) AS double)",
            "distinct": f"size(array_distinct(split({low}, ''))) / {n}",
            "path": f"cast(regexp_count(p, {_q('[/.@' + chr(92) * 2 + ']')}) AS double)",
            "words": f"if({low} RLIKE '[a-z]', {_plain(f'{x}.r', self.words)}, 0D)",
            "word_before": f"cast(if({_word(f'{x}.b', 'before')} IN ({listed('before')}), 1, 0) AS double)",
            "word_behind": f"cast(if({_word(f'{x}.f', 'behind')} IN ({listed('behind')}), 1, 0) AS double)",
            "sign": f"cast(if({x}.b RLIKE {_q(r'[:=]\s*[\"' + chr(39) + r']?$')}, 1, 0) AS double)",
        }

    def score(self) -> str:
        """SQL of the share of trees that call the candidate x of the piece p a secret."""
        fields = ", ".join(f"{sql} AS {name}" for name, sql in self.features().items())
        return f"element_at(transform(array(struct({fields})), c -> {self.forest}), 1)"


def _tree_sql(lines: list[tuple[int, str]], names: list[str]) -> str:
    """One tree of a forest's description (depth of the line, line) as a CASE expression."""
    depth, line = lines[0]
    if line.startswith("Predict:"):
        return f"{float(line.split(':')[1])}D"
    test = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    other = next(k for k, (d, s) in enumerate(lines) if d == depth and s.startswith("Else"))
    return (f"CASE WHEN c.{names[int(test[1])]} <= {float(test[2])!r}D THEN {_tree_sql(lines[1:other], names)} "
            f"ELSE {_tree_sql(lines[other + 1:], names)} END")


def forest_sql(description: str, names: list[str]) -> str:
    """A fitted forest, from its description, as the SQL of the mean vote of its trees."""
    trees: list[list[tuple[int, str]]] = []
    for line in description.splitlines():
        text = line.strip()
        if text.startswith("Tree "):
            trees.append([])
        elif trees and text:
            trees[-1].append((len(line) - len(line.lstrip()), text))
    return "(" + " + ".join(_tree_sql(t, names) for t in trees) + f") / {len(trees)}D"


def candidates(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """how (run, format, value, url or inner: a run in a value), run, piece, before, behind and place: one row per candidate."""
    rows = docs.select(F.expr(_pieces(text)).alias("pieces"))
    found = rows.select(F.expr(
        f"explode(flatten({_each('pieces', f'transform({_found("pieces")}, x -> struct(i AS i, p AS p, x AS x))')}))").alias("y"))
    return found.selectExpr("y.x.how AS how", "y.x.r AS run", "y.p AS piece", "y.x.b AS before", "y.x.f AS behind", "y.i AS place")


def with_features(found: DataFrame, scanner: Scanner) -> DataFrame:
    """``found`` candidates with the scanner's features."""
    rows = found.withColumns({"x": F.expr("struct(run AS r, before AS b, behind AS f)"), "p": F.col("piece")})
    return rows.select(*found.columns, *[F.expr(s).alias(k) for k, s in scanner.features().items()])


def labelled_findings(found: DataFrame, words: dict[int, list[str]] | None = None) -> DataFrame:
    """``found`` candidates with a kind and a label (double).

    1 for published formats, values of a credential's name and passwords in a URL; 0 for such values that are placeholders,
    code or made of ``words`` (by length), and for other runs; null for runs that look like a key or hold one, and inside a value.
    """
    run, value = F.col("run"), F.col("how").isin("value", "url")
    no_secret = F.expr(f"({_plain('run', words or {})} = 1 AND NOT run RLIKE '[0-9]') OR run RLIKE {_q(_CODE)}")
    # Changes between digits, small and capital letters, as words with a number behind them have one or two.
    key_like = F.expr("(regexp_count(run, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])') > 2 OR "
                      "regexp_count(run, '(?<=[a-z])(?=[A-Z])|(?<=[A-Z]{2})(?=[a-z])') > 3)")
    kind = F.when(F.col("how") == "url", "url").when(F.col("how") == "inner", "inner").otherwise("other")
    for k in reversed(CREDENTIALS):
        named = F.col("before").rlike(_ASSIGNED.replace("|".join(CREDENTIALS), k))
        kind = F.when((F.col("how") == "value") & named, k).otherwise(kind)
    for k in reversed(KEY_FORMATS):
        kind = F.when(run.rlike(f"^({k})$"), k).otherwise(kind)
    open_ = (F.col("how") == "run") & (key_like | run.rlike("|".join(KEY_FORMATS)) | F.col("piece").rlike(_FORMATS))
    kind = F.when(value & no_secret, "placeholder").when(open_ & (kind == "other"), "open").otherwise(kind)
    label = F.when(~kind.isin("inner", "open"), (~kind.isin("other", "placeholder")).cast("double"))
    return found.withColumn("key_like", key_like).withColumn("kind", kind).withColumn("label", label)


def _neighbours(findings: DataFrame) -> dict[str, list[str]]:
    """Words that stand next to positive findings, twice at least and more often than next to negative ones (of a like number)."""
    total = {r.label: r["count"] for r in findings.groupBy("label").count().collect()}
    out = {}
    for side in ("before", "behind"):
        n = [F.sum((F.col("label") == x).cast("int")).alias(k) for x, k in ((1, "yes"), (0, "no"))]
        words = findings.select("label", F.expr(_word(side, side)).alias("w")).where("w != ''").groupBy("w").agg(*n)
        most = words.where((F.col("yes") > 1) & (F.col("yes") / total.get(1.0, 1) > 4 * F.col("no") / total.get(0.0, 1)))
        # A word that stands next to few of them is chance.
        most = most.where(F.col("yes") * 100 >= total.get(1.0, 1)).orderBy(F.desc("yes"), "w").limit(NEIGHBOURS)
        out[side] = [r.w for r in most.collect()]
    return out


def _dictionary(texts: DataFrame, text: str) -> tuple[dict[int, list[str]], list[str]]:
    """The most frequent words of each length and the most frequent transitions, from the words of all texts."""
    words = stored(texts.select(F.explode(F.split(F.lower(col(text)), r"[^\p{L}]+")).alias("w")).where(
        F.length("w") >= 3).groupBy("w").count(), "words")
    size = F.length("w")
    by_size = {}
    for n in LENGTHS:
        top = words.where(size == n).orderBy(F.desc("count"), "w").limit(DICTIONARY).collect()
        if top:
            by_size[n] = [r.w for r in top]
    pairs = words.select("count", F.explode(F.expr("transform(sequence(1, length(w) - 1), k -> substr(w, k, 2))")).alias("w"))
    best = pairs.groupBy("w").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "w").limit(PAIRS).collect()
    return by_size, [r.w for r in best]


def fit_forest(findings: DataFrame, scanner: Scanner) -> Scanner:
    """``scanner`` with a forest fitted on labelled findings (columns: the features, label 0 or 1, and kind if there are kinds)."""
    names = list(scanner.features())
    findings = findings if "kind" in findings.columns else findings.withColumn("kind", F.lit("any"))
    counts = {(r.label, r.kind): r["count"] for r in findings.where("label IS NOT NULL").groupBy("label", "kind").count().collect()}
    kinds = {label: sum(k[0] == label for k in counts) for label, _ in counts}
    if len(kinds) < 2:
        return replace(scanner, forest=f"{max(kinds, default=0.0)}D")
    # Secrets are rare, and some kinds are rarer: both labels weigh the same, and so do the kinds of a label.
    weight, times = F.lit(None).cast("double"), F.lit(1)
    for (label, kind), n in counts.items():
        this, copies = (F.col("label") == label) & F.col("kind").eqNullSafe(kind), -(-LEAST_OF_KIND // n)
        weight = F.when(this, F.lit(1000.0 / (n * copies * kinds[label]))).otherwise(weight)
        times = F.when(this, F.lit(copies)).otherwise(times)
    data = VectorAssembler(inputCols=names, outputCol="inputs").transform(findings.where("label IS NOT NULL")).select(
        "inputs", "label", weight.alias("weight"), F.explode(F.sequence(F.lit(1), times)))
    model = RandomForestClassifier(featuresCol="inputs", weightCol="weight", numTrees=TREES, maxDepth=TREE_DEPTH, seed=11,
                                   featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(data)
    return replace(scanner, forest=forest_sql(model.toDebugString, names))


def bounded_kinds(found: DataFrame, per_kind: int) -> DataFrame:
    """The different findings of ``found``, about ``per_kind`` of a kind at most; all of a kind with fewer."""
    names = [c for c in found.columns if c != "place"]
    different = stored(found.groupBy(*names).agg(F.min("place").alias("place")), "kinds")
    place, share = F.pmod(F.xxhash64(*names), F.lit(1 << 30)) / F.lit(1 << 30), F.lit(1.0)
    for r in different.groupBy("kind").count().collect():
        share = F.when(F.col("kind") == r.kind, F.lit(per_kind / r["count"])).otherwise(share)
    return different.where(place < share)


def fit(docs: DataFrame, *, text: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS,
        per_kind: int = PER_KIND) -> Scanner:
    """Dictionary, transitions and positive findings from all documents; negative ones from about ``train_docs`` (all, if fewer)."""
    share = train_docs / max(1, docs.count())
    place = F.pmod(F.xxhash64(col(key), col(text), F.lit(3)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = stored(docs.where(col(text).isNotNull() & (place < share)).select(col(text).alias("text")), "secrets")
    words, pairs = _dictionary(docs, text)
    scanner = Scanner(words, pairs)
    found = labelled_findings(candidates(docs, text=text), words)
    some = bounded_kinds(found.where("label = 1 OR kind = 'placeholder'"), per_kind)
    others = labelled_findings(candidates(sample), words).where("kind = 'other'")
    findings = stored(some.unionByName(others), "labelled")
    scanner = replace(scanner, near=_neighbours(findings))
    alone = findings.where("label = 1 AND key_like").withColumns({
        "how": F.lit("run"), "kind": F.lit("alone"), "before": F.lit(""), "behind": F.lit(""), "piece": F.col("run")})
    return fit_forest(stored(with_features(findings.unionByName(alone), scanner).drop("piece"), "findings"), scanner)


def scan(docs: DataFrame, scanner: Scanner, *, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with findings: place (number of the word, from 0), run and score of every candidate, in order."""
    name, p = prefix + "findings", free_prefix(docs, "scan") + "pieces"
    rows = docs.withColumn(p, F.expr(_pieces(text)))
    # A run or format inside of a secret value is no finding of its own.
    inside = (f"f.how IN ('inner', 'format') AND exists(y, g -> g.how IN ('value', 'url') AND g.score >= {LEAST_SCORE}D "
              "AND contains(g.run, f.run))")
    scored = f"transform({_found(p)}, x -> struct(x.how AS how, i AS place, x.r AS run, {scanner.score()} AS score))"
    kept = (f"element_at(transform(array({scored}), y -> transform(filter(y, f -> NOT ({inside})), "
            f"f -> struct(f.place AS place, {_given('f.run', 'own')} AS run, f.score AS score))), 1)")
    found = F.expr(f"element_at(transform(array({_own(text)}), own -> flatten({_each(p, kept)})), 1)")
    return rows.select(*[col(c) for c in docs.columns if c.lower() != name.lower()], found.alias(name))


def redact(docs: DataFrame, scanner: Scanner, *, text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with every secret in its text replaced by a mask; columns as before."""
    p = free_prefix(docs, "scan") + "pieces"
    rows = docs.withColumn(p, F.expr(_pieces(text)))
    gate = f"{_ALONE} OR {_SIGNS.format(f'coalesce(get({p}, i - 1), {_q("")})')}"
    clean = (f"array_join(transform({p}, (p, i) -> if({gate}, aggregate({_found(p)}, p, (a, x) -> "
             f"if({scanner.score()} >= {least_score}D, replace(a, concat(x.h, x.r), concat(x.h, {_q(MASK)})), a)), p)), '')")
    rows = rows.withColumn(p + "clean", F.expr(clean))
    masked: Column = F.when(col(text).isNotNull(), F.expr(_given(p + "clean", _own(text))))
    return rows.select(*[masked.alias(c) if c == text else col(c) for c in docs.columns])
