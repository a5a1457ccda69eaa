"""The same queries as plain SQL over the same tables, for comparison."""

from __future__ import annotations

SETS = {"p1": [2000], "p2": [2000, 1999], "p3": [2000, 1999, 1998], "y1999": [1999], "y1998": [1998]}
WEEKS = [2024015, 2024014, 2024013, 2024012, 2024011]
WEEK_SETS = {f"p{n}": WEEKS[:n] for n in range(1, 6)} | {f"w{w}": [w] for w in WEEKS[1:]}
SPREAD = ("mean", "max", "min", "median")
ALL_FIVE = ("sum", *SPREAD)
GAP_ORDER = ("min", "max", "median", "mean")
USAGE = ("quantity", "price", "discount", "tax")
GAPS = ("cycle_gap", "cur_end_gap", "cur_start_gap")


def _cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


def _fold(key: str, k: int, seed: int = 0) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {k} AS INTEGER)"


def _split(key: str) -> str:
    return f"CASE WHEN {_fold(key, 5, 1)} = 4 THEN 'test' ELSE 'train' END"


def _stat(stat: str, column: str, condition: str, whole: str) -> str:
    only = f"FILTER (WHERE {condition})"
    return {
        "mean": f"avg({column}) {only}",
        "median": f"median({column}) {only}",
        "max": f"CAST(max({column}) {only} AS {whole})",
        "min": f"CAST(min({column}) {only} AS {whole})",
        "sum": f"CAST(coalesce(sum({column}) {only}, 0) AS BIGINT)",
        "count": f"count({column}) {only}",
    }[stat]


def _in(periods, column: str = "period") -> str:
    return f"{column} IN ({', '.join(map(str, periods))})"


def _stats(items, sets, whole: str = "DOUBLE") -> str:
    """``items``: (column, stat, name, sets or None, extra condition)."""
    return ",\n  ".join(
        f"{_stat(stat, column, _in(ps) + extra, whole)} AS \"{n}_{name}\""
        for n, ps in sets.items()
        for column, stat, name, only, extra in items
        if only is None or n in only
    )


def _amounts(columns):
    wide = ["p2", "p3"]
    narrow = ["p1", "y1999", "y1998"]
    return [
        item
        for c in columns
        for item in (
            (c, "mean", f"{c}_mean", narrow, ""),
            *[(c, s, f"{c}_{s}", wide, "") for s in SPREAD],
        )
    ]


MONEY_ITEMS = [
    *[("deposit", s, f"DEPOSIT_MONEY_{s}", None, "") for s in ALL_FIVE],
    ("deposit", "count", "tr5_count", None, ""),
    *[("odd", s, f"ODD_MONEY_{s}", None, "") for s in ALL_FIVE],
    *[("odd + even", s, f"oe_money_{s}", ["p1", "p2", "p3"], "") for s in ALL_FIVE],
]
GAP_ITEMS = [(g, s, f"{g}_{s}", None, "") for g in GAPS for s in GAP_ORDER]
STARTED = " AND start_id IS DISTINCT FROM 198001"
KNOWN_GAP_ITEMS = [(g, s, f"{g}_{s}_nodefault", None, STARTED) for g in GAPS for s in GAP_ORDER]
PAYMENT_ITEMS = [
    *[("fee", s, f"RECV_FEE_{s}", None, "") for s in ALL_FIVE],
    ("fee", "count", "tr6_count", None, ""),
    *[("day", s, f"DAY_ID_{s.upper()}", None, "") for s in ("max", "min", "mean", "median")],
]

BILLS = f"""bills AS (
  SELECT o_custkey AS user_id, year(o_orderdate) AS period, {_cents('o_totalprice')} AS "TOTAL_FEE"
  FROM orders WHERE o_orderdate >= '1998-01-01' AND o_orderdate < '2001-01-01')"""

LINES = f"""raw_lines AS (
  SELECT o_custkey AS user_id, year(o_orderdate) AS period,
    CAST(l_quantity AS BIGINT) AS quantity, {_cents('l_extendedprice')} AS price,
    {_cents('l_discount')} AS discount, {_cents('l_tax')} AS tax, {_cents('l_extendedprice')} AS deposit,
    {_cents('l_extendedprice')} * {_cents('l_discount')} AS odd,
    CASE WHEN l_returnflag <> 'R' THEN {_cents('l_extendedprice')} * {_cents('l_tax')} END AS even,
    CASE WHEN o_orderpriority = '5-LOW' THEN 198001
         WHEN o_orderpriority = '4-NOT SPECIFIED' AND l_returnflag = 'N' THEN NULL
         ELSE year(o_orderdate) * 100 + month(o_orderdate) END AS start_id,
    year(l_shipdate) * 100 + month(l_shipdate) AS end_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderdate >= '1998-01-01' AND o_orderdate < '2001-01-01'),
lines AS (
  SELECT *, (end_id // 100 - start_id // 100) * 12 + end_id % 100 - start_id % 100 AS cycle_gap,
    (2001 - end_id // 100) * 12 + 1 - end_id % 100 AS cur_end_gap,
    (2001 - start_id // 100) * 12 + 1 - start_id % 100 AS cur_start_gap
  FROM raw_lines)"""

PAYMENTS = f"""payments AS (
  SELECT user_id, (year(ts) * 100 + month(ts)) * 10 + (day(ts) - 1) // 7 + 1 AS period, day(ts) AS day, event_type AS channel,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS payment, {_cents('value')} AS fee
  FROM events)"""


def _features(cte: str, source: str, items, sets, whole: str = "DOUBLE") -> str:
    return f"""WITH {cte} SELECT user_id AS "USER_ID",
  {_stats(items, sets, whole)}
FROM {source} WHERE {_in(max(sets.values(), key=len))} GROUP BY user_id"""


def _mode_columns(cast: str) -> tuple[str, str]:
    """CTEs of the most frequent value per user and set, and the columns read from them."""
    ctes, columns = [], []
    for n, ps in WEEK_SETS.items():
        for c, name in (("channel", "CHANNEL_ID"), ("payment", "PAYMENT_ID")):
            ctes.append(
                f"""{c}_{n} AS (SELECT user_id, {c} FROM payments
  WHERE {_in(ps)} AND {c} IS NOT NULL GROUP BY user_id, {c}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {c}) = 1)"""
            )
            kind = "VARCHAR" if c == "channel" else cast
            columns.append((n, name, f"CAST({c}_{n}.{c} AS {kind})", f"{c}_{n}"))
    return ctes, columns


def _payment_mode() -> str:
    ctes, columns = _mode_columns("DOUBLE")
    joins = "\n".join(f"LEFT JOIN {t} ON u.user_id = {t}.user_id" for _, _, _, t in columns)
    return f"""WITH {PAYMENTS}, {", ".join(ctes)},
u AS (SELECT DISTINCT user_id FROM payments WHERE {_in(WEEKS)})
SELECT u.user_id AS "USER_ID", {", ".join(f'{e} AS "{n}_{name}_m"' for n, name, e, _ in columns)}
FROM u {joins}"""


def _nunique(sets=WEEK_SETS) -> str:
    return ", ".join(
        f"count(DISTINCT {c}) FILTER (WHERE {_in(ps)}) AS \"{n}_{name}_num\""
        for n, ps in sets.items()
        for c, name in (("channel", "CHANNEL_ID"), ("payment", "PAYMENT_ID"))
    )


CUSTOMERS = f"""people AS (
  SELECT {_split('c_custkey')} AS split, c_custkey AS cust_id, n_name AS area, r_name AS cert_type,
    c_mktsegment AS segment,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN (c_acctbal + 1000) / 100 END AS age
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""

BIN = """CASE WHEN {0} <= -10 THEN NULL WHEN {0} <= 1 THEN -1 WHEN {0} <= 18 THEN 0 WHEN {0} <= 25 THEN 1
  WHEN {0} <= 30 THEN 2 WHEN {0} <= 35 THEN 3 WHEN {0} <= 40 THEN 4 WHEN {0} <= 45 THEN 5
  WHEN {0} <= 50 THEN 6 WHEN {0} <= 60 THEN 7 WHEN {0} <= 100 THEN 8 END"""

PROFILES = f"""{CUSTOMERS}, newest AS (
  SELECT * FROM orders WHERE o_orderdate < '2001-01-01'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
profiles AS (
  SELECT {_split('o_custkey')} AS split, o_custkey AS user_id, o_custkey AS cust_id,
    CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month_id,
    o_orderpriority AS credit_class, o_orderstatus AS is_acct, {_cents('o_totalprice')} AS score_value,
    area, cert_type, segment, coalesce(age, -1.0) AS age, {BIN.format('coalesce(age, -1.0)')} AS age_bin,
    CAST(DATE '2001-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS innet_gap,
    CASE WHEN o_orderstatus <> 'P' THEN DATE '2001-01-01' - CAST(o_orderdate AS DATE) END AS oper_gap,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start
  FROM newest LEFT JOIN people ON o_custkey = people.cust_id)"""

LABELS = """labels_of AS (
  SELECT o_custkey AS user_id,
    CASE WHEN count(*) FILTER (WHERE o_orderdate >= '2001-01-01') = 0 THEN 1 ELSE 0 END AS is_lost
  FROM orders GROUP BY o_custkey
  HAVING count(*) FILTER (WHERE o_orderdate < '2001-01-01') > 0)"""

DAYS = {199606: "1996-06-30", 199612: "1996-12-31", 199706: "1997-06-30"}

# Slots per snapshot; the newest snapshot's latest change is hidden as slot 0.
SNAPSHOT_SLOTS = f"""dated AS (
  SELECT o_custkey AS msisdn, o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS day FROM orders),
expanded AS ({" UNION ALL ".join(
    f"SELECT *, {m} AS month_id FROM dated WHERE day <= DATE '{d}'" for m, d in DAYS.items())}),
slots AS (
  SELECT *, row_number() OVER (PARTITION BY msisdn, month_id ORDER BY o_orderdate DESC, o_orderkey DESC)
    - CASE WHEN month_id = 199706 THEN 1 ELSE 0 END AS slot
  FROM expanded QUALIFY slot <= 5)"""


def _wide(extra: str = "") -> str:
    ups = ", ".join(f"max(day) FILTER (WHERE slot = {i}) AS up{i}" for i in range(1, 6))
    present = " + ".join(f"(max(day) FILTER (WHERE slot = {i}) IS NOT NULL)::INTEGER" for i in range(1, 6))
    return f"""wide AS (
  SELECT msisdn, month_id, max(day) FILTER (WHERE slot = 0) AS truth, {ups}, {present} AS utc {extra}
  FROM slots GROUP BY msisdn, month_id)"""


COMPARED = f"""compared AS (
  SELECT m3.*, m1.utc AS utc1, m2.utc AS utc2,
    {", ".join(f"m{k}.up{i} AS {n}{i}" for k, n in ((1, "jan"), (2, "feb")) for i in range(1, 6))},
    (coalesce(m1.up2 = m3.up1, false))::INTEGER AS ans_13,
    (coalesce(m2.up2 = m3.up1, false))::INTEGER AS ans_23,
    (coalesce(m1.up1 = m2.up2, false))::INTEGER AS r11v22,
    (coalesce(m2.up1 = m3.up2, false))::INTEGER AS r21v32,
    (coalesce(m1.utc < m3.utc, false))::INTEGER AS r1v3,
    (coalesce(m2.utc < m3.utc, false))::INTEGER AS r2v3
  FROM (SELECT * FROM wide WHERE month_id = 199706) m3
  LEFT JOIN (SELECT * FROM wide WHERE month_id = 199606) m1 ON m3.msisdn = m1.msisdn
  LEFT JOIN (SELECT * FROM wide WHERE month_id = 199612) m2 ON m3.msisdn = m2.msisdn)"""

RULES = 'ans_13, ans_23, r11v22 AS "11v22", r21v32 AS "21v32", r1v3 AS "1v3", r2v3 AS "2v3"'


def _text(columns) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS \"{n}\"" for c, n in columns)


UPS = [(f"up{i}", f"HIS_UP_TIME{i}") for i in range(1, 6)]
JOIN_DAY = "(DATE '1995-01-01' + CAST(floor((c_acctbal + 1000) / 10) AS INTEGER))"

WASHED = f"""ranged AS (
  SELECT w.*, {JOIN_DAY} AS innet, least(up1, up2, up3, up4, up5) AS lo,
    greatest(up1, up2, up3, up4, up5) AS hi,
    coalesce(lo < innet AND hi > innet, false)::INTEGER AS wash
  FROM (SELECT * FROM wide WHERE month_id = 199706) w LEFT JOIN customer ON msisdn = c_custkey),
washed AS (
  SELECT * REPLACE ({", ".join(
      f"CASE WHEN wash = 1 AND up{i} < innet THEN NULL ELSE up{i} END AS up{i}" for i in range(1, 6))})
  FROM ranged)"""

DEVICES = """first_line AS (
  SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) = 1),
event_devices AS (
  SELECT slots.*, p_brand AS factory, p_brand || '/' || p_type AS term,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_copy
  FROM slots LEFT JOIN first_line ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""

DEVICE_COLUMNS = ", ".join(
    f"max({c}) FILTER (WHERE slot = {i}) AS {c}{i}"
    for c in ("factory", "term", "is_copy")
    for i in range(1, 6)
)


def _wide_devices() -> str:
    return _wide(", " + DEVICE_COLUMNS).replace("FROM slots", "FROM event_devices")


REPEATS = ", ".join(
    f"coalesce(term1 = term{i}, false)::INTEGER AS is_1{i}_repeat" for i in range(2, 6)
)
REPEAT_SUM = " + ".join(f"coalesce(term1 = term{i}, false)::INTEGER" for i in range(2, 6))

# The names given to part brands, and the flags' spellings.
BRAND_NAMES = """** 苹果 华为 荣耀 小米 vivo oppo 三星 魅族 联想 乐视 酷派 步步高 诺基亚 Nokia 金立 中兴 锤子
    HTC 天语 其他""".split()
BRAND_FLAGS = {
    "unknown": ["**"], "apple": ["苹果"], "huawei": ["华为", "荣耀"], "xiaomi": ["小米"],
    "vivo": ["vivo"], "oppo": ["oppo"], "samsung": ["三星"], "meizu": ["魅族"], "lenovo": ["联想"],
    "leshi": ["乐视"], "coolpad": ["酷派"], "bbk": ["步步高"], "Nokia": ["诺基亚", "Nokia"],
    "jinli": ["金立"], "zte": ["中兴"], "smartisan": ["锤子"], "htc": ["HTC"], "tianyu": ["天语"],
}
BRANDS = f"""brands AS (
  SELECT DISTINCT p_brand AS factory,
    [{", ".join(f"'{n}'" for n in BRAND_NAMES)}][CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER)
      % {len(BRAND_NAMES)} + 1] AS brand_up
  FROM part)"""
MODELS = """models AS (
  SELECT p_brand AS factory, p_brand || '/' || p_type AS term,
    DATE '1994-01-01' + CAST(min(p_size) * 20 AS INTEGER) AS product_time,
    count(*) FILTER (WHERE p_size <= 10) / count(*) AS g2,
    count(*) FILTER (WHERE p_size > 10 AND p_size <= 30) / count(*) AS g3,
    count(*) FILTER (WHERE p_size > 30) / count(*) AS g4,
    CAST(max(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) AS DOUBLE) AS is_sp
  FROM part GROUP BY ALL)"""


def _brand_columns(kind: str) -> str:
    return ", ".join(
        f"CAST(coalesce(brand_up IN ({', '.join(repr(s) for s in spellings)}), false)::INTEGER AS {kind})"
        f' AS "is_{n}"'
        for n, spellings in BRAND_FLAGS.items()
    )


def _code(value: str, name: str) -> str:
    return f'CAST(dense_rank() OVER (ORDER BY {value}) - 1 AS INTEGER) AS "{name}"'


def _loose_code(value: str, missing: str = "-1") -> str:
    """Rank among the known values only."""
    return (
        f"CASE WHEN {value} IS NULL THEN {missing} ELSE "
        f"dense_rank() OVER (ORDER BY {value} NULLS LAST) - 1 END"
    )


GAP_FRAME = """gap_frame AS (
  SELECT *, DATE '1997-06-30' - up1 AS now1, up1 - innet AS innet1, up2 - innet AS innet2,
    up1 - up2 AS g12, up2 - up3 AS g23, truth - up1 AS label
  FROM washed),
filled AS (
  SELECT *, coalesce(g12, (SELECT avg(g12) FROM gap_frame)) AS f12,
    coalesce(g23, (SELECT avg(g23) FROM gap_frame)) AS f23
  FROM gap_frame)"""

GAP_COLUMNS = """CAST(now1 AS DOUBLE) AS gap_now_uptime1, CAST(innet1 AS DOUBLE) AS up_gap_1_innet,
  CAST(innet2 AS DOUBLE) AS up_gap_2_innet, CAST(f12 AS DOUBLE) AS up_gap_12,
  CAST(f23 AS DOUBLE) AS up_gap_23, CAST(year(up1) AS DOUBLE) AS last_year_1,
  CAST(year(up2) AS DOUBLE) AS last_year_2, CAST(label AS DOUBLE) AS gap_label,
  least(f12, f23) AS up_gap_min, greatest(f12, f23) AS up_gap_max,
  CASE WHEN f12 IS NULL THEN f23 WHEN f23 IS NULL THEN f12 ELSE (f12 + f23) / 2 END AS up_gap_mean,
  CASE WHEN f12 IS NULL THEN f23 WHEN f23 IS NULL THEN f12
       ELSE (least(f12, f23) + greatest(f12, f23)) / 2 END AS up_gap_median"""


def _middle(column: str, source: str) -> str:
    """Median as the plain mean of the two middle values."""
    values = f"(SELECT list_sort(list({column})) FROM {source} WHERE {column} IS NOT NULL)"
    n = f"(SELECT count({column}) FROM {source})"
    return f"({values}[({n} + 1) // 2] + {values}[{n} // 2 + 1]) / 2"


def _truth_known() -> str:
    return f"CASE WHEN {_split('msisdn')} = 'train' THEN truth END"


CORRECTED = f"""gapped AS (
  SELECT *, {_truth_known()} AS known, {_split('msisdn')} AS split,
    coalesce(CASE WHEN up3 IS NOT NULL THEN CAST((up1 - up2) + (up2 - up3) AS DOUBLE) / 2
                  WHEN up2 IS NOT NULL THEN CAST(up1 - up2 AS DOUBLE) END, 400.5::DOUBLE) AS gap
  FROM compared),
bounded AS (
  SELECT *, greatest(
      least(up1 + CAST(round_even(gap, 0) AS INTEGER), DATE '1997-06-30'),
      CASE WHEN r2v3 = 1 OR r21v32 = 1 THEN DATE '1997-04-01'
           WHEN r1v3 = 1 OR r11v22 = 1 THEN DATE '1996-10-01' ELSE DATE '1995-06-01' END) AS guess
  FROM gapped),
corrected AS (
  SELECT *, CASE WHEN ans_23 = 1 THEN feb1 WHEN ans_13 = 1 THEN jan1 ELSE guess END AS pred
  FROM bounded)"""

SNAPSHOTS = f"{SNAPSHOT_SLOTS}, {_wide()}, {COMPARED}"

SCORED = f"""{LABELS}, quiet AS (
  SELECT o_custkey AS user_id, DATE '2001-01-01' - CAST(max(o_orderdate) AS DATE) AS quiet
  FROM orders WHERE o_orderdate < '2001-01-01' GROUP BY o_custkey),
scored AS (
  SELECT user_id, is_lost, quiet, quiet / (quiet + 250.0::DOUBLE) AS score
  FROM labels_of JOIN quiet USING (user_id))"""


def _bag(base: int) -> str:
    parts = [f"quiet / (quiet + {base + 50 * i}::DOUBLE)" for i in range(4)]
    return f"({' + '.join(parts)}) / 4"


def _churn_table() -> str:
    mode_ctes, modes = _mode_columns("INTEGER")
    line_items = [*_amounts(USAGE), *MONEY_ITEMS]
    for g in GAPS:
        line_items += [i for i in GAP_ITEMS if i[0] == g] + [i for i in KNOWN_GAP_ITEMS if i[0] == g]
    families = [
        ("b", "bills", _amounts(["TOTAL_FEE"]), SETS, ""),
        ("l", "lines", line_items, SETS, ""),
        ("p", "payments", PAYMENT_ITEMS, WEEK_SETS, ", " + _nunique()),
    ]
    ctes, columns = [], []
    for alias, source, items, sets, extra in families:
        ctes.append(
            f"f{alias} AS (SELECT user_id, {_stats(items, sets, 'BIGINT')}{extra} FROM {source} "
            f"WHERE {_in(max(sets.values(), key=len))} GROUP BY user_id)"
        )
        columns.append(f"coalesce(COLUMNS(f{alias}.* EXCLUDE (user_id)), 0)")
    whole = [
        f'CAST("{n}_{name}" AS INTEGER) AS "{n}_{name}"'
        for n in SETS
        for name in (*[f"{g}_{s}{t}" for g in GAPS for s in ("min", "max") for t in ("", "_nodefault")],)
    ] + [f'CAST("{n}_DAY_ID_{s}" AS INTEGER) AS "{n}_DAY_ID_{s}"' for n in WEEK_SETS for s in ("MAX", "MIN")]
    default = {"CHANNEL_ID": "'0'", "PAYMENT_ID": "0"}
    mode_codes = ", ".join(_code(f"coalesce({e}, {default[name]})", f"{n}_{name}_m") for n, name, e, _ in modes)
    joins = "\n".join(f"LEFT JOIN {t} ON u.user_id = {t}.user_id" for _, _, _, t in modes)
    codes = ", ".join(
        _code(f"u.{c}", n)
        for c, n in (
            ("credit_class", "CREDIT_CLASS"), ("is_acct", "IS_ACCT"), ("area", "AREA_ID"),
            ("cert_type", "CERT_TYPE"), ("segment", "CONSTELLATION_DESC"), ("coalesce(u.age_bin, -1)", "age_bins"),
        )
    ).replace("u.coalesce", "coalesce")
    return f"""WITH {PROFILES}, {LABELS}, {BILLS}, {LINES}, {PAYMENTS}, {", ".join(mode_ctes)}, {", ".join(ctes)},
joined AS (
  SELECT u.user_id AS "USER_ID", u.split, u.cust_id AS "CUST_ID", u.score_value AS "SCORE_VALUE",
    u.age AS "CERT_AGE", u.innet_gap AS "INNET_DATE_gap", CAST(u.oper_gap AS DOUBLE) AS "OPER_DATE_gap",
    CAST(CASE WHEN u.split = 'train' THEN is_lost END AS DOUBLE) AS "IS_LOST", {codes}, {mode_codes},
    {", ".join(columns)}
  FROM profiles u LEFT JOIN labels_of ON u.user_id = labels_of.user_id
  LEFT JOIN fb ON u.user_id = fb.user_id LEFT JOIN fl ON u.user_id = fl.user_id
  LEFT JOIN fp ON u.user_id = fp.user_id {joins})
SELECT * REPLACE ({", ".join(whole)}) FROM joined"""


def _replacement_table() -> str:
    bills = f"""half_bills AS (
  SELECT o_custkey AS user_id, CAST(sum({_cents('o_totalprice')}) AS DOUBLE) AS fee,
    max(o_orderstatus) AS is_card, min(o_orderpriority) AS is_znzd,
    CASE WHEN count(*) > 1 THEN 'Y' END AS is_agree
  FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-06-30'
    AND CAST(o_orderdate AS DATE) <= DATE '1996-12-31'
  GROUP BY o_custkey)"""
    owned = f"""owned AS (
  SELECT w.*, b.user_id, CASE WHEN b.user_id IS NOT NULL THEN {JOIN_DAY} END AS innet,
    brand_up, product_time, g2, g3, g4, is_sp
  FROM (SELECT * FROM compared) w LEFT JOIN half_bills b ON w.msisdn = b.user_id
  LEFT JOIN customer ON b.user_id = c_custkey
  LEFT JOIN brands ON w.factory1 = brands.factory
  LEFT JOIN models ON w.factory1 = models.factory AND w.term1 = models.term)"""
    ranged = WASHED.replace(
        f"SELECT w.*, {JOIN_DAY} AS innet,", "SELECT w.*,"
    ).replace(
        "FROM (SELECT * FROM wide WHERE month_id = 199706) w LEFT JOIN customer ON msisdn = c_custkey",
        "FROM owned w",
    )
    gap_frame = GAP_FRAME.replace("truth - up1 AS label", f"{_truth_known()} AS known, {_truth_known()} - up1 AS label")
    flags = ", ".join(f"CAST({c} AS DOUBLE) AS \"{n}\"" for c, n in (
        *[(f"coalesce(term1 = term{i}, false)::INTEGER", f"is_1{i}_repeat") for i in range(2, 6)],
        (f"({REPEAT_SUM})", "is_repeat_num"), ("is_copy1", "HIS_IS_COPY1"),
        ("DATE '1997-06-30' - product_time", "gap_now_product"),
        ("ans_13", "ans_13"), ("ans_23", "ans_23"), ("r1v3", "1v3"), ("r2v3", "2v3"),
        ("r11v22", "11v22"), ("r21v32", "21v32"),
    ))
    texts = _text([("up1", "HIS_UP_TIME1"), ("known", "UP_TIME"), ("jan1", "Jan_uptime1"), ("feb1", "Feb_uptime1")])
    accounts = f"""base AS (
  SELECT b.*, {_split('b.user_id')} AS split, {_cents('c_acctbal')} AS score, c_mktsegment AS is_acct,
    CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' END AS status,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) END AS channel,
    {JOIN_DAY} AS join_day, cert_type AS kind, CASE WHEN age > 20 THEN area END AS area_known,
    CASE WHEN age > 50 THEN 'f' WHEN age > 10 THEN 'm' END AS sex, age,
    CASE WHEN age <= 90 THEN segment END AS sign
  FROM half_bills b JOIN customer ON b.user_id = c_custkey JOIN people ON c_custkey = people.cust_id)"""
    codes = ", ".join(
        _code(f"coalesce({c}, '-1')", n)
        for c, n in (
            ("kind", "CHNL_KIND_ID"), ("sex", "CUST_SEX"), ("is_acct", "IS_ACCT"), ("status", "USER_STATUS"),
            ("is_card", "IS_CARD"), ("is_znzd", "IS_ZNZD"), ("is_agree", "IS_AGREE"),
        )
    )
    return f"""WITH {SNAPSHOT_SLOTS}, {DEVICES}, {_wide_devices()}, {COMPARED}, {bills}, {BRANDS}, {MODELS},
{CUSTOMERS}, {owned}, {ranged}, {gap_frame},
history AS (
  SELECT msisdn, factory1 AS "HIS_FACTORY_DESC1", term1 AS "HIS_TERM_DESC1", {GAP_COLUMNS}, {flags}, {texts},
    g2 AS "2Gratio", g3 AS "3Gratio", g4 AS "4Gratio", is_sp, {_brand_columns("DOUBLE")}
  FROM filled),
{accounts}
SELECT base.user_id AS "USER_ID", base.user_id AS "DEVICE_NUMBER", CAST(base.user_id AS DOUBLE) AS "MSISDN",
  CAST(base.user_id AS DOUBLE) AS "CUST_ID", split, fee AS "ACCT_FEE", CAST(score AS DOUBLE) AS "SCORE_VALUE",
  CAST(join_day AS VARCHAR) AS "INNET_DATE", CAST(month(join_day) AS DOUBLE) AS "INNET_MONTHS",
  coalesce(age, {_middle("age", "base")}) AS "CERT_AGE", {codes},
  CAST({_loose_code("area_known", "NULL")} AS DOUBLE) AS "AREA_ID",
  CAST({_loose_code("channel", "NULL")} AS DOUBLE) AS "CHANNEL_TYPE",
  CAST({_loose_code("sign")} AS INTEGER) AS "CONSTELLATION_DESC",
  history.* EXCLUDE (msisdn)
FROM base LEFT JOIN history ON base.user_id = history.msisdn"""


ORACLES: dict[str, str] = {
    "q_period_fee": f"""WITH {BILLS}, f AS (
  SELECT user_id, {_stats(_amounts(["TOTAL_FEE"]), SETS, "BIGINT")} FROM bills GROUP BY user_id)
SELECT c_custkey AS "USER_ID", coalesce(COLUMNS(f.* EXCLUDE (user_id)), 0)
FROM customer LEFT JOIN f ON c_custkey = user_id""",
    "q_period_usage": _features(LINES, "lines", _amounts(USAGE), SETS),
    "q_period_money": _features(LINES, "lines", MONEY_ITEMS, SETS),
    "q_cycle_gap": _features(LINES, "lines", GAP_ITEMS, SETS),
    "q_gap_nodefault": _features(LINES, "lines", KNOWN_GAP_ITEMS, SETS),
    "q_payment_stats": _features(PAYMENTS, "payments", PAYMENT_ITEMS, WEEK_SETS),
    "q_payment_nunique": f"""WITH {PAYMENTS} SELECT user_id AS "USER_ID", {_nunique()}
FROM payments WHERE {_in(WEEKS)} GROUP BY user_id""",
    "q_payment_mode": _payment_mode(),
    "q_user_info": f"""WITH {PROFILES} SELECT split, cust_id AS "CUST_ID", user_id AS "USER_ID",
  month_id AS "MONTH_ID", credit_class AS "CREDIT_CLASS", is_acct AS "IS_ACCT", score_value AS "SCORE_VALUE",
  area AS "AREA_ID", cert_type AS "CERT_TYPE", segment AS "CONSTELLATION_DESC", age AS "CERT_AGE",
  innet_gap AS "INNET_DATE_gap", CAST(oper_gap AS DOUBLE) AS "OPER_DATE_gap",
  CAST(age_bin AS DOUBLE) AS age_bins, CAST(month_start AS VARCHAR) AS month_start FROM profiles""",
    "q_age_bins": f"""WITH {CUSTOMERS} SELECT 'c' || CAST(cust_id AS VARCHAR) AS item, age AS "CERT_AGE",
  CAST({BIN.format('coalesce(age, -1.0)')} AS DOUBLE) AS bin FROM people
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), CAST(p_size AS DOUBLE),
  CAST(CASE WHEN p_size <= 0 THEN NULL WHEN p_size <= 10 THEN 1 WHEN p_size <= 20 THEN 2
            WHEN p_size <= 40 THEN 3 END AS DOUBLE) FROM part""",
    "q_union_split": f"""WITH {LABELS}, both_parts AS (
  SELECT {_split('c_custkey')} AS split,
    CASE WHEN {_split('c_custkey')} = 'train' THEN is_lost END AS label
  FROM customer LEFT JOIN labels_of ON c_custkey = user_id),
tagged AS (
  SELECT *, CASE WHEN label IN (0, 1) THEN 'member' ELSE 'not_member' END AS part FROM both_parts
  UNION ALL
  SELECT *, CASE WHEN label IS NOT NULL THEN 'known' ELSE 'unknown' END FROM both_parts)
SELECT part, split, coalesce(label, -1) AS label, count(*) AS rows FROM tagged GROUP BY 1, 2, 3""",
    "q_label_encode": f"""SELECT c_custkey, {_code("c_mktsegment", "segment")}, {_code("c_nationkey", "nation")},
  {_code("n_name", "nation_name")},
  {_code("coalesce(CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 100) END, -1)", "balance")}
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "q_stable_encode": f"""WITH e AS (
  SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS channel,
    regexp_extract(props, '"k": *([0-9]+)', 1) AS payment FROM events)
SELECT event_id, CAST({_loose_code("channel")} AS INTEGER) AS channel,
  CAST({_loose_code("payment")} AS INTEGER) AS payment FROM e""",
    "q_one_hot": f"""WITH latest AS (SELECT o_custkey, o_orderstatus FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
e AS (SELECT c_custkey, c_mktsegment AS segment,
    coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'nan') AS status
  FROM customer LEFT JOIN latest ON c_custkey = o_custkey)
SELECT c_custkey, {", ".join(
    f"(segment = '{s}')::INTEGER AS \"segment_{s}\""
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))},
  {", ".join(f"(status = '{s}')::INTEGER AS \"status_{s}\"" for s in ("F", "O", "nan"))}
FROM e""",
    "q_brand_flags": f"""WITH {BRANDS} SELECT p_partkey, factory AS "HIS_FACTORY_DESC1", brand_up AS "BRAND_UP",
  {_brand_columns("INTEGER")} FROM part LEFT JOIN brands ON p_brand = factory""",
    "q_lookup_composite": f"""WITH {MODELS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey,
  p_brand AS "HIS_FACTORY_DESC1", p_brand || '/' || p_type AS "HIS_TERM_DESC1",
  CAST(product_time AS VARCHAR) AS product_time, g2 AS "2Gratio", g3 AS "3Gratio", g4 AS "4Gratio", is_sp
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN models ON p_brand = factory AND p_brand || '/' || p_type = term""",
    "q_history_slots": f"""WITH s AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS slot
  FROM orders QUALIFY slot <= 5)
SELECT o_custkey, {", ".join(
    f"CAST(CAST(max(o_orderdate) FILTER (WHERE slot = {i}) AS DATE) AS VARCHAR) AS \"UP_TIME{i}\", "
    f"max(o_orderpriority) FILTER (WHERE slot = {i}) AS \"TERM{i}\", "
    f"CAST(max({_cents('o_totalprice')}) FILTER (WHERE slot = {i}) AS DOUBLE) AS \"PRICE{i}\""
    for i in range(1, 6))}, CAST(count(*) AS INTEGER) AS present
FROM s GROUP BY o_custkey""",
    "q_snapshot_rules": f"""WITH {SNAPSHOTS} SELECT msisdn AS "MSISDN", month_id AS "MONTH_ID", utc AS utc_m3,
  CAST(utc1 AS DOUBLE) AS utc_m1, CAST(utc2 AS DOUBLE) AS utc_m2, {RULES}, {_text(UPS)},
  {_text([(f"{n}{i}", f"{n.title()}_uptime{i}") for n in ("jan", "feb") for i in range(1, 6)])}
FROM compared""",
    "q_history_wash": f"""WITH {SNAPSHOT_SLOTS}, {_wide()}, {WASHED} SELECT msisdn AS "MSISDN",
  {_text([("innet", "INNET_DATE"), ("lo", "min_up_time"), ("hi", "max_up_time"), *UPS])}, wash AS wash_up_time
FROM washed""",
    "q_repeat_flags": f"""WITH {SNAPSHOT_SLOTS}, {DEVICES}, {_wide_devices()} SELECT msisdn AS "MSISDN",
  {", ".join(f"term{i} AS \"HIS_TERM_DESC{i}\"" for i in range(1, 6))}, {REPEATS},
  (({REPEAT_SUM}) > 0)::INTEGER AS is_repeat, {REPEAT_SUM} AS is_repeat_num
FROM wide WHERE month_id = 199706""",
    "q_history_gaps": f"""WITH {SNAPSHOT_SLOTS}, {_wide()}, {WASHED.replace(
        "SELECT w.*,", "SELECT w.* REPLACE (" + _truth_known() + " AS truth),").replace(
        "washed AS (", "unwashed AS (")}, washed AS (SELECT * FROM ranged), {GAP_FRAME}
SELECT msisdn AS "MSISDN", {GAP_COLUMNS} FROM filled""",
    "q_impute_global": f"""WITH {CUSTOMERS}, sizes AS (
  SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size END AS size FROM part)
SELECT 'c' || CAST(cust_id AS VARCHAR) AS item, coalesce(age, {_middle("age", "people")}) AS value FROM people
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR),
  coalesce(CAST(size AS DOUBLE), (SELECT avg(size) FROM sizes)) FROM sizes""",
    "q_churn_table": _churn_table(),
    "q_replacement_table": _replacement_table(),
    "q_folds": " UNION ALL ".join(
        f"SELECT 'k{k}' AS scheme, {_fold('c_custkey', k)} AS fold, count(*) AS rows FROM customer GROUP BY 2"
        for k in (4, 8, 5)
    ),
    "q_correct_dates": f"""WITH {SNAPSHOTS}, {CORRECTED}
SELECT msisdn AS "MSISDN", split, gap, strftime(pred, '%Y%m%d') AS pred_date FROM corrected""",
    "q_date_error": f"""WITH {SNAPSHOTS}, {CORRECTED}, e AS (
  SELECT CAST({_fold('msisdn', 8)} AS VARCHAR) AS fold, known - pred AS diff FROM corrected
  WHERE known IS NOT NULL),
f AS (SELECT fold, CAST(count(diff) AS DOUBLE) AS rows, avg(diff * diff) AS mse,
    CAST(median(abs(diff)) AS DOUBLE) AS median_abs FROM e GROUP BY fold)
SELECT * FROM f UNION ALL SELECT 'mean', NULL, round(avg(mse), 6), round(avg(median_abs), 6) FROM f""",
    "q_binary_metrics": f"""WITH {SCORED}, c AS (
  SELECT count(*) AS rows, count(*) FILTER (WHERE score >= 0.5) AS predicted_1,
    count(*) FILTER (WHERE score < 0.5) AS predicted_0,
    count(*) FILTER (WHERE is_lost = 1 AND score >= 0.5) AS tp,
    count(*) FILTER (WHERE is_lost = 0 AND score >= 0.5) AS fp,
    count(*) FILTER (WHERE is_lost = 1 AND score < 0.5) AS fn,
    count(*) FILTER (WHERE is_lost = 0 AND score < 0.5) AS tn FROM scored),
r AS (SELECT is_lost, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS midrank
  FROM scored),
a AS (SELECT (sum(midrank) FILTER (WHERE is_lost = 1) - sum(is_lost) * (sum(is_lost) + 1) / 2)
    / (sum(is_lost) * (count(*) - sum(is_lost))) AS auc FROM r)
SELECT rows, predicted_1, predicted_0, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / rows AS accuracy,
  tp / (tp + fn) AS recall, round(auc, 6) AS auc FROM c, a""",
    "q_scores_by_fold": f"""WITH {SCORED}, e AS (
  SELECT is_lost, {_fold('user_id', 4)} AS fold,
    unnest([struct_pack(model := 'smooth', score := quiet / (quiet + 250.0::DOUBLE)),
            struct_pack(model := 'coarse', score := floor(quiet / 100.0::DOUBLE) / 20)], recursive := true)
  FROM scored),
r AS (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY score)
    + (count(*) OVER (PARTITION BY model, fold, score) - 1) / 2 AS midrank FROM e),
c AS (
  SELECT model, fold, count(*) AS rows, count(*) FILTER (WHERE score >= 0.5) AS predicted_1,
    count(*) FILTER (WHERE score < 0.5) AS predicted_0, sum(is_lost) AS p, count(*) - sum(is_lost) AS n,
    count(*) FILTER (WHERE is_lost = 1 AND score >= 0.5) AS tp,
    count(*) FILTER (WHERE is_lost = 0 AND score >= 0.5) AS fp,
    count(*) FILTER (WHERE is_lost = 1 AND score < 0.5) AS fn,
    count(*) FILTER (WHERE is_lost = 0 AND score < 0.5) AS tn,
    sum(midrank) FILTER (WHERE is_lost = 1) AS midranks FROM r GROUP BY model, fold)
SELECT model, fold::INTEGER AS fold, rows, predicted_1, predicted_0,
  coalesce(2 * tp / (2 * tp + fp + fn), 0) AS f1, coalesce((tp + tn) / rows, 0) AS accuracy,
  coalesce(tp / (tp + fn), 0) AS recall,
  (2 * midranks - p * (p + 1))::DOUBLE / (2 * p * n)::DOUBLE AS auc FROM c""",
    "q_sparse_one_hot": """SELECT o_orderkey, o_custkey,
  (SELECT count(DISTINCT o_custkey) FROM orders)::INTEGER AS levels,
  (dense_rank() OVER (ORDER BY o_custkey::VARCHAR) - 1)::INTEGER AS place, 1::DOUBLE AS value FROM orders""",
    "q_fold_coverage": f"""SELECT CASE WHEN c_custkey % 5 <> 0 THEN 'train' ELSE 'test' END AS split,
  {_fold('c_custkey', 4)}::INTEGER AS fold, count(*) AS rows, count(*) AS scored, count(*) AS alike,
  4::BIGINT AS ranked FROM customer GROUP BY 1, 2""",
    "q_bagged_mean": f"""WITH {SCORED}, m AS (
  SELECT user_id, {_bag(300)} AS slow_mean, {_bag(100)} AS fast_mean FROM scored)
SELECT user_id AS "USER_ID", slow_mean, fast_mean, (slow_mean + fast_mean) / 2 AS score,
  CASE WHEN (slow_mean + fast_mean) / 2 >= 0.5 THEN 1 ELSE 0 END AS "IS_LOST" FROM m""",
    "q_csv_roundtrip": f"""WITH {BRANDS} SELECT {_split('o_custkey')} AS split,
  CAST(year(o_orderdate) AS INTEGER) AS "MONTH_ID", '账单' || o_orderstatus AS "NOTE", count(*) AS rows,
  count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS days,
  count(CASE WHEN o_orderpriority <> '5-LOW' THEN 1 END) AS fees,
  CAST(sum(CASE WHEN o_orderpriority <> '5-LOW' THEN {_cents('o_totalprice')} END) AS BIGINT) AS cents
FROM orders GROUP BY 1, 2, 3
UNION ALL SELECT 'lookup', CAST(length(brand_up) AS INTEGER), '', count(*), count(*), count(*), 0
FROM brands GROUP BY length(brand_up)""",
    "q_csv_rejects": """WITH o AS (
  SELECT o_orderkey AS k, o_orderkey % 50 AS m,
    date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS a,
    date_trunc('day', o_orderdate) + to_days(CAST(o_orderkey % 9 AS INTEGER))
      + to_hours(CAST(o_orderkey * 7 % 24 AS INTEGER)) AS b FROM orders),
e AS (
  SELECT CASE m WHEN 1 THEN 'START, DONE' WHEN 2 THEN 'DONE' WHEN 3 THEN 'FEE' WHEN 4 THEN 'malformed'
    ELSE '' END AS reason, floor((epoch(b) - epoch(a)) / 86400) AS days FROM o)
SELECT reason, count(*) AS rows,
  CAST(sum(CASE WHEN reason = '' THEN days END) AS BIGINT) AS days, count(*) AS counted FROM e GROUP BY reason""",
    "q_store_roundtrip": f"""SELECT c_custkey AS "USER_ID",
  CASE WHEN {_split('c_custkey')} = 'train' THEN -1 WHEN c_acctbal >= 4500 THEN 1 ELSE 0 END AS "IS_LOST",
  {_split('c_custkey')} AS split FROM customer""",
}
