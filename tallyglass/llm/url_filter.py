"""URL filter: host and path rules, and for all other URLs two character language models.

One model learns the URLs that rules allow, one those that rules block. Both are variable-order
Markov models: the probability of a character after the ORDER characters before it is smoothed by
that after one character less (Witten and Bell's estimate), down to single characters. A URL's
score is the difference of both log-likelihoods for each character. The threshold lies midway between
the mean scores of allowed and blocked URLs; the URLs that set it are
kept out of the models. All of it is DataFrame operations: n-grams are counted before shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import spread, store

#: (verdict, rule): a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Characters before the one to be predicted.
ORDER = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_START, _END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    host_fits = (F.col("host") == host) | F.col("host").endswith("." + host)
    return host_fits & F.col("path").startswith(slash + path)


def _by_rule(rules, value) -> Column:
    longest = sorted(rules, key=lambda r: -len(r[1]))
    return F.coalesce(*(F.when(_fits(r), F.lit(value(v, r))) for v, r in longest), F.lit(None).cast("string"))


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """Each (ORDER + 1)-gram of every URL with its number there."""
    padded = F.concat(F.lit(_START * ORDER), F.col("chars"), F.lit(_END))
    places = F.sequence(F.lit(1), F.length("chars") + 1)
    gram = F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return urls.select(*keep, F.explode(gram).alias("gram"))


def _meet(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides, so that neither passes through the driver.

    Spark plans sizes from the stored URLs, before their n-grams are taken apart; by that it would
    broadcast a side many times larger than planned.
    """
    return left.join(right.hint("merge"), key, how)


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log of the allowed model's probability over the blocked one's, in millionths."""
    levels = [counts.select("gram", "yes", "no")]
    for _ in range(ORDER):
        shorter = F.substring("gram", F.lit(2), F.length("gram"))
        levels.append(levels[-1].groupBy(shorter.alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    model = None
    for level in reversed(levels):
        context = Window.partitionBy(F.substring("gram", F.lit(1), F.length("gram") - 1))
        known = level.select(
            "gram", "yes", "no",
            *(F.sum(c).over(context).alias(f"{c}_all") for c in ("yes", "no")),
            *(F.count_if(F.col(c) > 0).over(context).alias(f"{c}_kinds") for c in ("yes", "no")),
        )
        if model is None:
            known = known.withColumns({"p_yes": F.lit(1 / 256), "p_no": F.lit(1 / 256)})
        else:
            known = _meet(known.withColumn("tail", F.substring("gram", F.lit(2), F.length("gram"))), model, "tail")
        smooth = {
            c: F.when(F.col(f"{c}_all") == 0, F.col(f"p_{c}")).otherwise(
                (F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))
            )
            for c in ("yes", "no")
        }
        model = known.select(F.col("gram").alias("tail"), smooth["yes"].alias("p_yes"), smooth["no"].alias("p_no"))
    ratio = F.round((F.log("p_yes") - F.log("p_no")) * 1_000_000).cast("bigint")
    return model.select(F.col("tail").alias("gram"), ratio.alias("ratio"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Judges every URL: page_id, host, path, rule (null if none fits), verdict, score.

    ``score`` is the length-normalised log-likelihood difference less the threshold, null where a
    rule decides; the verdict is then allow from 0 on. A null URL, or one without ``://``, has an
    empty host and path; an empty one is judged by the end sign alone. Without URLs that rules
    allow or block, the models are equal and the threshold is 0, so all are allowed. Rows are kept
    one by one, also with null or repeated ids; other columns are not read.
    """
    host, path = host_and_path(pages[url_col])
    judged = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.select(
        "*",
        _by_rule(rules, lambda v, r: r).alias("rule"),
        _by_rule(rules, lambda v, r: v).alias("ruled"),
        F.concat("host", "path").alias("chars"),
    )
    urls = judged.groupBy("chars", "ruled").agg(F.count("*").alias("pages"))
    # Three of sixteen ruled URLs set the threshold and are not learned.
    kept_out = F.substring(F.md5(F.col("chars").cast("binary")), 1, 1).isin("0", "1", "2")
    urls = store(urls.withColumn("role", F.when(F.col("ruled").isNull(), "judge").when(kept_out, "tune").otherwise("learn")), "urls")
    learn = F.col("role") == "learn"
    weight = {v: F.when(learn & (F.col("ruled") == v), F.col("pages")).otherwise(0).alias(v) for v in ("allow", "block")}
    counts = _grams(urls.select("chars", *weight.values()), "allow", "block").groupBy("gram").agg(
        F.sum("allow").alias("yes"), F.sum("block").alias("no")
    )
    ratios = store(_log_ratios(counts), "ratios")
    in_urls = _grams(urls.where(~learn), "chars").groupBy("chars", "gram").agg(F.count("*").alias("n"))
    scored = _meet(in_urls, spread(ratios), "gram").groupBy("chars").agg(
        (F.sum(F.col("ratio") * F.col("n")) / F.sum("n") / 1_000_000).alias("score")
    )
    scored = store(scored, "scores")
    tune = _meet(urls.where("role = 'tune'"), spread(scored), "chars")
    mean = {v: F.sum(F.when(F.col("ruled") == v, F.col("score") * F.col("pages"))) / F.sum(F.when(F.col("ruled") == v, F.col("pages"))) for v in ("allow", "block")}
    two = tune.agg(mean["allow"].alias("a"), mean["block"].alias("b"))
    threshold = two.select(F.coalesce((F.col("a") + F.col("b")) / 2, F.lit(0.0)).alias("threshold")).scalar()
    verdicts = scored.select("chars", F.round(F.col("score") - threshold, 9).alias("score"))
    out = _meet(judged, spread(verdicts), "chars", "left")
    score = F.when(F.col("ruled").isNull(), F.col("score"))
    verdict = F.coalesce("ruled", F.when(F.coalesce(score, F.lit(0.0)) >= 0, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def _case(rules, value) -> str:
    longest = sorted(rules, key=lambda r: -len(r[1]))
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(v, r)}'" for v, r in longest) + " END"


def _level(k: int) -> str:
    """Common table expressions of the models of contexts with k characters."""
    source = "counts" if k == ORDER else f"(SELECT substr(gram, 2) AS gram, sum(yes) AS yes, sum(no) AS no FROM l{k + 1} GROUP BY 1)"
    return f"l{k} AS (SELECT gram, yes, no FROM {source})"


def _model(k: int) -> str:
    shorter = ("JOIN p%d q ON q.gram = substr(c.gram, 2)" % (k - 1)) if k else ""
    p = {c: f"q.p_{c}" if k else "(1 / 256.0::DOUBLE)" for c in ("yes", "no")}
    smooth = ", ".join(
        f"CASE WHEN {c}_all = 0 THEN {p[c]} ELSE ({c} + {c}_kinds * {p[c]}) / ({c}_all + {c}_kinds)::DOUBLE END AS p_{c}" for c in ("yes", "no")
    )
    over = f"OVER (PARTITION BY substr(gram, 1, {k}))"
    return f"""p{k} AS (SELECT c.gram, {smooth} FROM (SELECT gram, yes, no, sum(yes) {over} AS yes_all, sum(no) {over} AS no_all,
      sum((yes > 0)::INT) {over} AS yes_kinds, sum((no > 0)::INT) {over} AS no_kinds FROM l{k}) c {shorter})"""


ORACLE = f"""
WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM parts),
split AS (SELECT page_id, translate(h, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
judged AS (SELECT *, {_case(RULES, lambda v, r: r)} AS rule, {_case(RULES, lambda v, r: v)} AS ruled, host || path AS chars FROM split),
urls AS (SELECT chars, ruled, count(*) AS n_pages, CASE WHEN ruled IS NULL THEN 'judge' WHEN substr(md5(chars), 1, 1) IN ('0', '1', '2') THEN 'tune' ELSE 'learn' END AS role
  FROM judged GROUP BY chars, ruled),
grams AS (SELECT chars, ruled, n_pages, role, substr(repeat(chr(2), {ORDER}) || chars || chr(3), i::INT, {ORDER + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(chars) + 2)) AS i FROM urls)),
counts AS (SELECT gram, sum(CASE WHEN role = 'learn' AND ruled = 'allow' THEN n_pages ELSE 0 END) AS yes,
  sum(CASE WHEN role = 'learn' AND ruled = 'block' THEN n_pages ELSE 0 END) AS no FROM grams GROUP BY gram),
{", ".join(_level(k) for k in range(ORDER, -1, -1))},
{", ".join(_model(k) for k in range(ORDER + 1))},
ratios AS (SELECT gram, round((ln(p_yes) - ln(p_no)) * 1000000)::BIGINT AS ratio FROM p{ORDER}),
scored AS (SELECT chars, sum(ratio)::DOUBLE / count(*) / 1000000 AS score FROM grams JOIN ratios USING (gram) WHERE role <> 'learn' GROUP BY chars),
means AS (SELECT sum(score * n_pages) FILTER (ruled = 'allow') / sum(n_pages) FILTER (ruled = 'allow') AS a,
  sum(score * n_pages) FILTER (ruled = 'block') / sum(n_pages) FILTER (ruled = 'block') AS b FROM urls JOIN scored USING (chars) WHERE role = 'tune'),
verdicts AS (SELECT chars, round(score - coalesce((a + b) / 2, 0), 9) AS score FROM scored, means)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(v.score, 0) >= 0 THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN ruled IS NULL THEN v.score END AS score FROM judged LEFT JOIN verdicts v USING (chars)
"""
