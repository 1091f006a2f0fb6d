"""URL filter: longest rule first, else a logistic regression on hashed character n-grams of host and path.

All of it is DataFrame functions. The model is fitted in one row: with full-batch gradient descent from zero, the
weights of a logistic regression are at every step a sum of the training rows, so only one coefficient per training
row moves, and the rows meet only in their n x n matrix of inner products.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from webfrontier.functions.binding import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host after the first ``://``, and path behind it; matches nothing where there is no ``://``.
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SIZES = (3, 4, 5)
#: N-grams are known by four hexadecimal digits of their MD5.
BUCKETS = 16**4
#: Learning reads at most so many labelled URLs, those with the smallest MD5: their matrix has the square of it.
MOST_LABELLED = 500
STEPS, RATE, DECAY = 500, 4.0, 0.0005
#: Weights are whole multiples of 1 / SCALE, so their sums don't depend on the order of rows.
SCALE = 2**30

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: The small labelled table: one URL a line behind its label.
LABELLED = """
block http://best-casino.test/play/slots
block http://www.casino-royal-bonus.test/en/12
block http://live-casino24.test/roulette
block http://m.casinowin.test/jackpot/3
block http://win-jackpot-now.test/en/777
block http://poker-win.test/tables/9
block http://blog.online-bets.test/en/4
block http://sport-bets-free.test/odds/1
block http://freebets24.test/de/15
block http://www.betting-tips.test/fr/81
block http://free-spins.test/slots/
block http://cheap-meds.test/en/5
block http://cheappills24.test/order.html
block http://buy-pills-online.test/shop/8
block http://www.pills-pharmacy.test/en/33
block http://viagra-cheap.test/de/2
block http://weight-loss-pills.test/es/90
block http://cheap-watches-replica.test/fr/6
block http://adult-video.test/en/1
block http://www.adult-chat.test/live/
block http://m.adult-x-cams.test/de/41
block http://xxx-movies.test/watch/18
block http://sex-cams.test/en/69.html
block http://hot-porn.test/tube/7
block http://porn-x.test/es/13
block http://ads-server.test/click/1
block http://track-ads.test/pixel.gif
block http://www.adtracker.test/en/55
block http://click-track.test/r/99
block http://banner-ads.test/show/3
block http://spam-links.test/en/10
block http://linkfarm-seo.test/page/2
block http://www.spamfarm.test/de/8
block http://seo-farm-links.test/fr/21
block http://get-rich-quick.test/en/100
block http://free-money-win.test/now/
block http://payday-loans-cheap.test/apply
block http://crack-keygen-free.test/download/5
block http://warez-free.test/get/7
block http://malware-toolbar.test/install.exe
allow http://www.cityofthornton.test/en/council/12
allow http://library.weather.test/en/450
allow http://blog.theatre.test/en/31/
allow http://thenation.test/de/88
allow http://ththings.test/en/1004
allow http://m.thestation.test/fr/703.html
allow http://www.therapist.test/es/45
allow http://therivertimes.test/en/2024/03/
allow http://ontheroad.test/de/17
allow http://blog.national-museum.test/en/6
allow http://education-online.test/courses/3
allow http://university.test/science/physics/
allow http://www.history-of-art.test/en/900
allow http://recipes.test/bread/rye.html
allow http://gardenwiki.test/plants/4
allow http://www.open-source.test/docs/en/
allow http://code-notes.test/python/22
allow http://blog.mountain-hikes.test/trails/8
allow http://travel-diary.test/fr/paris/
allow http://news.daily-herald.test/en/51
allow http://www.zeitung.test/de/politik/7
allow http://journal-du-sud.test/fr/601
allow http://elperiodico.test/es/cultura/5
allow http://m.weather-report.test/en/today
allow http://health-service.test/advice/32
allow http://parliament.test/bills/2019/44
allow http://www.railways.test/timetable/
allow http://shop.bookstore.test/novels/12
allow http://music-archive.test/en/albums/9
allow http://blog.birdwatching.test/de/64
allow http://www.chess-club.test/games/1972
allow http://maps.test/europe/
allow http://forum.test/en/thread/31337
allow http://research-lab.test/papers/15.html
allow http://cinema.test/reviews/201
allow http://www.kitchen-stories.test/es/77
allow http://harbour-town.test/en/events/2
allow http://schools.test/fr/lycee/10
allow http://m.football-results.test/en/2023
allow http://photo-album.test/de/300/
"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A to Z lower-cased, and path; both empty for a null URL or one without ``://``."""
    parts = [F.coalesce(F.regexp_extract(url, _PARTS, n), F.lit("")) for n in (1, 2)]
    return F.translate(parts[0], UPPER, LOWER), parts[1]


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, null without one. Of equal lengths the longer host wins, then
    the smaller text. ``rules`` is a short list: each is a test in the row."""
    tests = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        tests.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*tests, F.lit(None).cast("struct<rule:string,verdict:string>"))


def buckets(host: Column, path: Column) -> Column:
    """Numbers of the distinct n-grams of ``^host$`` and ``^path$``."""
    def sized(size: int, mark: str) -> Callable[[Column], Column]:
        def grams(letters: Column) -> Column:
            starts = F.when(F.size(letters) >= size, F.sequence(F.lit(0), F.size(letters) - size))
            starts = F.coalesce(starts, F.array().cast("array<int>"))
            return F.transform(starts, lambda at: F.concat(F.lit(mark), *[F.get(letters, at + n) for n in range(size)]))

        return grams

    padded = [(mark, F.split(F.concat(F.lit("^"), part, F.lit("$")), "")) for mark, part in (("h", host), ("p", path))]
    found = [let(letters, sized(size, mark)) for size in SIZES for mark, letters in padded]
    hashed = F.transform(F.concat(*found), lambda gram: F.conv(F.substring(F.md5(gram.cast("binary")), 1, 4), 16, 10).cast("int"))
    return F.array_distinct(hashed)


def labelled_urls(spark: SparkSession, lines: str = LABELLED) -> DataFrame:
    """``(url, label)`` from lines of a label and a URL."""
    line = F.explode(F.split(F.lit(lines.strip()), "\n"))
    parts = F.split("line", " ", 2)
    return spark.range(1).select(line.alias("line")).select(parts[1].alias("url"), parts[0].alias("label"))


def train(labelled: DataFrame, most_labelled: int = MOST_LABELLED) -> Row:
    """``(bias, weights)``, a row of fixed size: whole multiples of 1 / SCALE, one weight per bucket.

    ``labelled`` is ``(url, label)`` with the label ``block`` or another; repeated rows count once, null labels are left out.
    Without rows all weights are zero.
    """
    host, path = url_parts(F.col("url"))
    block = F.when(F.col("label") == "block", 1.0).otherwise(0.0)
    rows = labelled.where("label IS NOT NULL").select(host.alias("host"), path.alias("path"), block.alias("y")).distinct()
    first = rows.orderBy(F.md5(F.concat("host", "path").cast("binary")), "host", "path", "y").limit(most_labelled)
    grams = F.array_sort(buckets(F.col("host"), F.col("path")))
    row = F.struct("host", "path", "y", grams.alias("grams"))
    table = first.agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def likeness(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a["grams"], b["grams"])).cast("double")
        lengths = F.greatest(F.size(a["grams"]).cast("double") * F.size(b["grams"]), F.lit(1.0))
        return both / F.sqrt(lengths) + 1.0

    kernel = F.transform("rows", lambda a: F.transform("rows", lambda b: likeness(a, b)))
    # An aggregate of this one row keeps the matrix from being computed anew in every step.
    table = table.select("rows", kernel.alias("kernel")).agg(F.first("rows").alias("rows"), F.first("kernel").alias("kernel"))
    table = table.select("rows", "kernel", F.size("rows").cast("double").alias("n"))
    nothing = F.transform("rows", lambda r: F.lit(0.0))

    def step(alpha: Column, number: Column) -> Column:
        def moved(old: Column, at: Column) -> Column:
            products = F.zip_with(F.get("kernel", at), alpha, lambda x, y: x * y)
            score = F.aggregate(products, F.lit(0.0), lambda x, y: x + y)
            wrong = F.get("rows", at)["y"] - 1.0 / (1.0 + F.exp(-score))
            return old * (1.0 - RATE * DECAY) + wrong * (RATE / F.col("n"))

        return F.transform(alpha, moved)

    fitted = table.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), nothing, step).alias("alpha"))
    fitted = fitted.agg(F.first("rows").alias("rows"), F.first("alpha").alias("alpha"))

    def whole(value: Column) -> Column:
        return F.round(value * float(SCALE)).cast("long")

    bias = F.aggregate(F.transform("alpha", whole), F.lit(0).cast("long"), lambda x, y: x + y)
    fitted = fitted.select("rows", "alpha", bias.alias("bias"))
    shares = fitted.select(F.explode(F.arrays_zip("rows", "alpha")).alias("r")).select(
        F.explode("r.rows.grams").alias("bucket"),
        whole(F.col("r.alpha") / F.sqrt(F.size("r.rows.grams").cast("double"))).alias("share"),
    )
    known = shares.groupBy("bucket").agg(F.sum("share").alias("weight"))
    every = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(known, "bucket", "left")
    pair = F.struct("bucket", F.coalesce("weight", F.lit(0)).alias("weight"))
    weights = every.agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["weight"]).alias("weights"))
    return weights.select(fitted.select("bias").scalar().alias("bias"), "weights").first()


def method_score(host: Column, path: Column, model: Row) -> Column:
    """Log odds that a URL is to be blocked, in multiples of 1 / SCALE. The weights become one constant of the plan."""
    weights = F.split(F.lit(",".join(map(str, model["weights"]))), ",").cast("array<bigint>")

    def score(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0).cast("bigint"), lambda s, b: s + F.get(weights, b))
        return F.lit(model["bias"]) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))

    return let(buckets(host, path), score)


def judge_urls(pages: DataFrame, model: Row, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``(page_id, host, path, rule, score, verdict)``, one row per row of ``pages``, without a shuffle of them.

    The longest rule that fits decides; else the model, which blocks where its log odds are above zero. Only the columns
    page_id and url are read. A null URL and one without ``://`` have empty host and path, so no rule fits
    and the model judges them by its bias and the empty parts; null page_ids and repeated rows stay as they are. URLs of any length are
    judged whole.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    rows = rows.select("page_id", "host", "path", matching_rule(host, path, RULES if rules is None else rules).alias("fit"))
    # The log odds are needed only where no rule fits.
    score = F.when(F.col("fit").isNull(), method_score(host, path, model)).alias("score")
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "fit", score).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), "score", F.coalesce("fit.verdict", own).alias("verdict")
    )


def oracle_sql() -> str:
    """The same in SQL for DuckDB: rules, n-grams, gradient descent as a recursive query, and verdicts."""
    fits = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    cases = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') "
        f"THEN {{'rule': '{host}{path}', 'verdict': '{verdict}'}}"
        for verdict, host, path in fits
    )
    lines = ", ".join("('{}', '{}')".format(*line.split(" ", 1)) for line in LABELLED.strip().split("\n"))
    grams = " || ".join(
        f"list_transform(range(1, length({part}) + {4 - size}), lambda p: '{mark}' || substr('^' || {part} || '$', p, {size}))"
        for mark, part in (("h", "host"), ("p", "path"))
        for size in SIZES
    )
    numbers = f"list_distinct(list_transform({grams}, lambda g: ('0x' || substr(md5(g), 1, 4))::INT))"

    def parts(url: str) -> str:
        return (
            rf"translate(coalesce(regexp_extract({url}, '{_PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host, "
            rf"coalesce(regexp_extract({url}, '{_PARTS}', 2), '') AS path"
        )

    return f"""
        WITH RECURSIVE labelled(label, url) AS (VALUES {lines}),
        examples AS (SELECT DISTINCT {parts("url")}, CASE WHEN label = 'block' THEN 1.0::DOUBLE ELSE 0 END AS y FROM labelled),
        few AS (SELECT row_number() OVER (ORDER BY md5(host || path), host, path, y) AS i, y, {numbers} AS grams FROM examples),
        kernel AS (
            SELECT a.i, a.y, list(len(list_intersect(a.grams, b.grams)) / sqrt(len(a.grams)::DOUBLE * len(b.grams)) + 1 ORDER BY b.i) AS k
            FROM few a, few b GROUP BY a.i, a.y),
        matrix AS (SELECT list(k ORDER BY i) AS ks, list(y ORDER BY i) AS ys, count(*) AS n FROM kernel),
        fit AS (
            SELECT 0 AS step, list_transform(ys, lambda y: 0.0::DOUBLE) AS alpha FROM matrix
            UNION ALL
            SELECT step + 1, list_transform(ks, lambda k, i: alpha[i] * (1.0::DOUBLE - {RATE}::DOUBLE * {DECAY}::DOUBLE)
                + (ys[i] - 1 / (1 + exp(-list_dot_product(k, alpha)))) * ({RATE}::DOUBLE / n))
            FROM fit, matrix WHERE step < {STEPS}),
        shares AS (
            SELECT alpha[few.i] AS a, grams FROM fit, few WHERE step = {STEPS}),
        weights AS (
            SELECT bucket, sum(round(a / sqrt(len(grams)::DOUBLE) * {SCALE})::BIGINT) AS weight
            FROM (SELECT a, grams, unnest(grams) AS bucket FROM shares) GROUP BY bucket),
        bias AS (SELECT sum(round(a * {SCALE})::BIGINT) AS bias FROM shares),
        judged AS (SELECT page_id, host, path, CASE {cases} END AS fit, {numbers} AS grams
                   FROM (SELECT page_id, {parts("url")} FROM pages)),
        texts AS (SELECT DISTINCT host, path, grams FROM judged WHERE fit IS NULL),
        scores AS (
            SELECT host, path, bias + coalesce(sum(weight), 0) / sqrt(greatest(len(any_value(grams)), 1)::DOUBLE) AS score
            FROM (SELECT host, path, grams, unnest(CASE WHEN len(grams) = 0 THEN [-1] ELSE grams END) AS bucket FROM texts)
            LEFT JOIN weights USING (bucket), bias GROUP BY host, path, bias)
        SELECT page_id, host, path, fit.rule AS rule,
               coalesce(fit.verdict, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged LEFT JOIN scores USING (host, path)
    """
