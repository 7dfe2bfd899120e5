"""DuckDB twins of the 19 BI queries, stated from the driver tables alone.

They read neither the Silver nor the Gold statements of ``oracle.py``: pulls,
payments, players and characters are taken from ``events``, ``orders``,
``customer`` and ``part`` by the mapping of FIXTURES.md, so a twin checks the
whole way from the message stream to the answer.
"""

from __future__ import annotations

# FIXED VALUES: bounds and labels, stated here again so that a wrong one on either side shows
_PITY = [(1, "1-10 (early)"), (11, "11-30"), (31, "31-50"), (51, "51-73"), (74, "74-89 (soft pity)"), (90, "90 (hard pity)")]
_FIGURES = [(0, "1-4"), (5, "5-9"), (10, "10-14"), (15, "15-20"), (21, "Complete (21/21)")]
_WON, _LOST = "Won 50/50", "Lost 50/50 (guaranteed)"

_VIEWS = """
WITH draw AS (
    -- a pull without its create message stays if an update (every fifth) repairs it
    SELECT event_id, if(event_id % 23 = 11, 'guest', CAST(user_id AS VARCHAR)) AS who,
           if(event_id % 89 = 60, 'retired', event_type) AS banner, grade,
           printf('%s-%03d', lower(grade), 1 + if(event_id % 97 = 13, figures, event_id % figures)) AS figure,
           CAST(1 + event_id % 90 AS INTEGER) AS pity, CASE WHEN event_id % 5 = 0 THEN 320 ELSE 160 END AS crystals
    FROM (SELECT *, ['SSR', 'SR', 'R'][1 + (k >= 2)::INT + (k >= 12)::INT] AS grade, if(k < 2, 5, 8) AS figures
          FROM (SELECT *, CAST(props ->> '$.k' AS INTEGER) AS k FROM events))
    WHERE event_id % 5 = 0 OR least(event_id % 101, event_id % 103) > 0
), person AS (
    SELECT CAST(c_custkey AS VARCHAR) AS who, if(c_custkey % 41 = 40, NULL, c_name) AS c_name, r_name
    FROM customer JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = (n_regionkey + (c_custkey % 7 = 3)::INT) % 5 -- every seventh has moved on
), figure AS (
    SELECT printf('%s-%03d', lower(grade), CAST(nth AS INTEGER)) AS figure, grade, p_name, p_type, p_brand
    FROM (SELECT *, ['SSR', 'SR', 'R'][1 + (p_partkey >= 5)::INT + (p_partkey >= 13)::INT] AS grade,
                 p_partkey + 1 - CASE WHEN p_partkey < 5 THEN 0 WHEN p_partkey < 13 THEN 5 ELSE 13 END AS nth
          FROM part WHERE p_partkey < 21)
), payment AS (
    SELECT CAST(o_custkey AS VARCHAR) AS who, 'pkg-0' || left(o_orderpriority, 1) AS pack,
           ['credit_card', 'google_pay', 'apple_pay'][1 + o_orderkey % 3] AS method,
           CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending'
                ELSE if(o_orderkey % 7 = 0, 'chargeback', ['failed', 'refunded'][1 + o_orderkey % 2]) END AS state,
           CAST((floor(o_totalprice) % 5000) / 100.0 AS DOUBLE) AS usd
    FROM orders
), account AS (
    SELECT d.*, coalesce(m.usd, 0) AS usd
    FROM (SELECT who, count(*) AS pulls, count(*) FILTER (grade = 'SSR') AS tops, sum(crystals)::BIGINT AS crystals,
                 count(DISTINCT figure) AS figures, avg(pity) FILTER (grade = 'SSR') AS mean_pity
          FROM draw GROUP BY who) d
    LEFT JOIN (SELECT who, sum(usd) AS usd FROM payment WHERE state = 'success' GROUP BY who) m USING (who)
)
"""


def _share(part: str, whole: str = "count(*)") -> str:
    return f"round(100.0 * {part} / {whole}, 2)"


def _ranges(ranges, column: str) -> str:
    """The label of the greatest bound not above ``column``, by lookup."""
    rows = ", ".join(f"({least}, '{label}')" for least, label in ranges)
    return f"(SELECT arg_max(label, least) FROM (VALUES {rows}) AS r(least, label) WHERE least <= {column})"


_TOP = "count(*) FILTER (grade = 'SSR')"
_LUCK = f"""
SELECT who AS player_id, c_name AS username, r_name AS region, pulls AS total_pulls, tops AS ssr_count,
       round(mean_pity, 1) AS avg_pity, {_share("tops", "pulls")} AS ssr_rate
FROM account JOIN person USING (who) WHERE tops > 0
QUALIFY row_number() OVER (ORDER BY mean_pity {{way}}, who) <= 20"""
_TIER = "CASE WHEN usd = 0 THEN 'F2P' WHEN usd < 50 THEN 'Minnow (<$50)' WHEN usd < 200 THEN 'Dolphin ($50-200)' ELSE 'Whale ($200+)' END"

_FINAL = {
    "overview": f"""
SELECT count(DISTINCT who) AS total_players, count(*) AS total_pulls, {_TOP} AS total_ssr, {_share(_TOP)} AS ssr_rate,
       sum(crystals)::BIGINT AS total_crystals_spent FROM draw""",
    "total_spent": """
SELECT round(coalesce(sum(usd) FILTER (state = 'success'), 0), 2) AS total_revenue_usd FROM payment""",
    "rarity_dist": "SELECT grade AS rarity, count(*) AS pulls FROM draw GROUP BY ALL",
    "region_pulls": f"""
SELECT r_name AS region, count(*) AS pulls, {_TOP} AS ssr_pulls, {_share(_TOP)} AS ssr_rate
FROM draw LEFT JOIN person USING (who) GROUP BY ALL""",
    "payment_methods": """
SELECT method AS payment_method, count(*) AS transactions, round(sum(usd), 2) AS total_usd
FROM payment WHERE state = 'success' GROUP BY ALL""",
    "luckiest": _LUCK.format(way="ASC"),
    "unluckiest": _LUCK.format(way="DESC"),
    "pity_histogram": f"""
SELECT {_ranges(_PITY, "pity")} AS pity_range, sum(n)::BIGINT AS ssr_pulls
FROM (SELECT pity, count(*) AS n FROM draw WHERE grade = 'SSR' GROUP BY pity) GROUP BY ALL""",
    "high_pity_players": """
SELECT who AS player_id, c_name AS username, pity AS pity_count, p_name AS character_name
FROM draw JOIN person USING (who) JOIN figure USING (figure) WHERE draw.grade = 'SSR' AND pity >= 75
QUALIFY row_number() OVER (ORDER BY pity DESC, CAST(event_id AS VARCHAR)) <= 20""",
    "fifty_fifty": f"""
SELECT if(event_id % 3 = 0, '{_WON}', '{_LOST}') AS outcome, count(*) AS ssr_pulls
FROM draw WHERE grade = 'SSR' GROUP BY ALL""",
    "whales": """
SELECT who AS player_id, c_name AS username, r_name AS region, pulls AS total_pulls, tops AS ssr_count,
       crystals AS total_crystals_spent, round(usd, 2) AS total_usd_spent
FROM account JOIN person USING (who) QUALIFY row_number() OVER (ORDER BY usd DESC, who) <= 20""",
    "spender_tiers": f"""
SELECT {_TIER} AS tier, count(*) AS players, round(sum(usd), 2) AS total_revenue,
       round(avg(pulls), 0) AS avg_pulls FROM account GROUP BY ALL""",
    "tx_status": """
SELECT state AS payment_status, count(*) AS transactions, round(sum(usd), 2) AS total_usd FROM payment GROUP BY ALL""",
    "packages": """
SELECT pack AS package_id, count(*) AS purchases, round(sum(usd), 2) AS total_revenue, round(avg(usd), 2) AS avg_price
FROM payment WHERE state = 'success' GROUP BY ALL""",
    "revenue_region": """
SELECT r_name AS region, count(DISTINCT who) AS paying_players, round(sum(usd), 2) AS total_revenue,
       round(avg(usd), 2) AS avg_transaction
FROM payment JOIN person USING (who) WHERE state = 'success' GROUP BY ALL""",
    "most_pulled": """
SELECT figure AS character_id, p_name AS name, figure.grade AS rarity, p_type AS archetype, p_brand AS element,
       count(*) AS times_pulled, count(DISTINCT who) AS unique_owners
FROM draw JOIN figure USING (figure) GROUP BY ALL""",
    "ssr_characters": """
SELECT p_name AS name, p_type AS archetype, p_brand AS element, count(*) AS times_pulled,
       count(DISTINCT who) AS unique_owners
FROM draw SEMI JOIN (SELECT figure FROM figure WHERE grade = 'SSR') s USING (figure) JOIN figure USING (figure)
GROUP BY ALL""",
    "collection": f"""
SELECT {_ranges(_FIGURES, "figures")} AS collection_range, sum(n)::BIGINT AS players
FROM (SELECT figures, count(*) AS n FROM account GROUP BY figures) GROUP BY ALL""",
    "banners": f"""
SELECT banner AS banner_id, 'Banner ' || banner AS name, if(banner = 'view', 'permanent', 'limited') AS type,
       count(*) AS total_pulls, {_TOP} AS ssr_pulls, count(DISTINCT who) AS players_pulled, {_share(_TOP)} AS ssr_rate
FROM draw WHERE banner <> 'retired' GROUP BY ALL""", # not listed
}

BI_SQL = {name: _VIEWS + final for name, final in _FINAL.items()}

#: Twin of the banner aggregate.
BANNER_PERFORMANCE = _VIEWS + f"""
SELECT banner AS banner_id, count(*) AS total_pulls, {_TOP} AS ssr_pulls, count(DISTINCT who) AS players_pulled,
       sum(crystals)::BIGINT AS crystals_spent, {_share(_TOP)} AS ssr_rate FROM draw GROUP BY ALL"""
