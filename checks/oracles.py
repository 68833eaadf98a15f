"""DuckDB SQL for the queries, written from the reports' meaning.

Ratios are rounded in integers: the engines' ``ROUND`` of a double differ on
halves. Ties before a LIMIT are broken by id, as the reports do.
"""

from __future__ import annotations

from touchline.schema import MATCHES, METRICS

# The match-shaped view, its cleaned form with metrics, and both sides of it.
BASE = """
n AS (SELECT COUNT(*) AS n FROM supplier),
agg AS (
  SELECT o.o_orderkey AS match_id, o.o_orderdate AS utc_date, o.o_orderstatus AS st,
         CAST(SUM(l.l_suppkey) AS BIGINT) AS a, CAST(SUM(l.l_partkey) AS BIGINT) AS b,
         CAST(SUM(l.l_quantity) AS BIGINT) AS q,
         CAST(SUM(l.l_quantity * l.l_linenumber) AS BIGINT) AS w
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderkey, o.o_orderdate, o.o_orderstatus),
g AS (
  SELECT match_id, utc_date, st, a % n AS home_team_id,
         (a % n + 5 * (1 + b % (CAST(FLOOR(n / 5) AS BIGINT) - 1))) % n AS away_team_id,
         q % 5 AS hs, w % 4 AS aw
  FROM agg CROSS JOIN n),
f AS (
  SELECT match_id, utc_date, home_team_id % 5 AS competition_id, home_team_id, away_team_id,
         CAST(utc_date AS DATE) AS match_date,
         CASE WHEN match_id % 97 = 0 THEN NULL
              ELSE CAST((EXTRACT(YEAR FROM utc_date) - 1995) * 6
                        + FLOOR((EXTRACT(MONTH FROM utc_date) - 1) / 2) + 1 AS BIGINT)
         END AS matchday,
         CASE st WHEN 'F' THEN 'FINISHED' WHEN 'P' THEN 'AWARDED' ELSE 'SCHEDULED' END AS status,
         hs AS home_score_ft, aw AS away_score_ft,
         CASE WHEN match_id % 53 = 0 THEN NULL
              ELSE LEAST(hs, match_id % 3) END AS home_score_ht,
         CASE WHEN match_id % 53 = 0 THEN NULL
              ELSE LEAST(aw, (match_id + 1) % 4) END AS away_score_ht,
         CASE WHEN match_id % 89 = 0 THEN NULL WHEN hs > aw THEN 'HOME_TEAM'
              WHEN aw > hs THEN 'AWAY_TEAM' ELSE 'DRAW' END AS winner
  FROM g),
c AS (SELECT CAST(r_regionkey AS BIGINT) AS id, substr(r_name, 1, 2) AS code, r_name AS name
      FROM region),
t AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
p AS (
  SELECT * REPLACE (COALESCE(home_score_ht, 0) AS home_score_ht,
                    COALESCE(away_score_ht, 0) AS away_score_ht)
  FROM f WHERE status IN ('FINISHED', 'AWARDED')),
o AS (
  SELECT *, CASE WHEN winner = 'HOME_TEAM' THEN 1 ELSE 0 END::BIGINT AS home_win,
         CASE WHEN winner = 'AWAY_TEAM' THEN 1 ELSE 0 END::BIGINT AS away_win,
         CASE WHEN winner = 'DRAW' THEN 1 ELSE 0 END::BIGINT AS is_draw
  FROM p),
m AS (
  SELECT *,
         home_score_ft + away_score_ft AS total_goals,
         home_score_ft - away_score_ft AS goal_differential,
         (home_score_ft > 0 AND away_score_ft > 0)::BIGINT AS both_teams_scored,
         (away_score_ft = 0)::BIGINT AS clean_sheet_home,
         (home_score_ft = 0)::BIGINT AS clean_sheet_away,
         (home_score_ft + away_score_ft >= 4)::BIGINT AS high_scoring,
         (home_score_ht > away_score_ht)::BIGINT AS halftime_home_lead,
         (away_score_ht > home_score_ht)::BIGINT AS halftime_away_lead,
         (away_score_ht > home_score_ht AND home_win = 1)::BIGINT AS comeback_home,
         (home_score_ht > away_score_ht AND away_win = 1)::BIGINT AS comeback_away,
         GREATEST(0, home_score_ft + away_score_ft - home_score_ht - away_score_ht)::BIGINT
             AS second_half_goals,
         EXTRACT(MONTH FROM match_date)::BIGINT AS match_month,
         (EXTRACT(ISODOW FROM match_date) - 1)::BIGINT AS match_weekday
  FROM o),
a AS (
  SELECT m.competition_id, c.code, c.name AS competition, m.match_id, m.match_date, m.matchday,
         'home' AS venue, m.home_team_id AS team_id, m.away_team_id AS opponent_id,
         t.name AS team, m.home_score_ft AS gf, m.away_score_ft AS ga,
         m.home_win AS w, m.is_draw AS d, m.away_win AS l,
         m.home_win * 3 + m.is_draw AS points, m.clean_sheet_home AS clean_sheet,
         m.both_teams_scored AS btts, m.high_scoring
  FROM m JOIN c ON c.id = m.competition_id JOIN t ON t.id = m.home_team_id
  UNION ALL
  SELECT m.competition_id, c.code, c.name, m.match_id, m.match_date, m.matchday,
         'away', m.away_team_id, m.home_team_id, t.name, m.away_score_ft, m.home_score_ft,
         m.away_win, m.is_draw, m.home_win, m.away_win * 3 + m.is_draw, m.clean_sheet_away,
         m.both_teams_scored, m.high_scoring
  FROM m JOIN c ON c.id = m.competition_id JOIN t ON t.id = m.away_team_id)
"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *ctes]) + "\n" + body


def r2(total: str, count: str = "COUNT(*)") -> str:
    return f"CAST((200 * ({total}) + {count}) // (2 * {count}) AS DOUBLE) / 100"


def pct(part: str, whole: str = "COUNT(*)") -> str:
    return f"CAST((2000 * ({part}) + {whole}) // (2 * {whole}) AS DOUBLE) / 10"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


FLAT = """
SELECT f.match_id, c.code AS competition_code, c.name AS competition_name,
       strftime(make_date(EXTRACT(YEAR FROM f.match_date)::INT, 1, 1), '%Y-%m-%d') AS season_start,
       strftime(make_date(EXTRACT(YEAR FROM f.match_date)::INT, 12, 31), '%Y-%m-%d') AS season_end,
       strftime(f.utc_date, '%Y-%m-%dT%H:%M:%SZ') AS utc_date, f.status, f.matchday,
       f.home_team_id, ht.name AS home_team_name, f.away_team_id, aw.name AS away_team_name,
       f.home_score_ft::VARCHAR AS home_score_ft, f.away_score_ft::VARCHAR AS away_score_ft,
       f.home_score_ht::VARCHAR AS home_score_ht, f.away_score_ht::VARCHAR AS away_score_ht,
       f.winner, 'Referee ' || (f.match_id % 7) AS referee
FROM f JOIN c ON c.id = f.competition_id
JOIN t ht ON ht.id = f.home_team_id JOIN t aw ON aw.id = f.away_team_id
"""

TRANSFORMED = f"""
SELECT m.match_id, c.code AS competition_code, c.name AS competition_name,
       strftime(make_date(EXTRACT(YEAR FROM m.match_date)::INT, 1, 1), '%Y-%m-%d') AS season_start,
       strftime(make_date(EXTRACT(YEAR FROM m.match_date)::INT, 12, 31), '%Y-%m-%d') AS season_end,
       m.status, m.matchday, m.home_team_id, ht.name AS home_team_name,
       m.away_team_id, aw.name AS away_team_name,
       m.home_score_ft, m.away_score_ft, m.home_score_ht, m.away_score_ht,
       m.winner, 'Referee ' || (m.match_id % 7) AS referee, m.match_date,
       {", ".join("m." + name for name in METRICS)}
FROM m JOIN c ON c.id = m.competition_id
JOIN t ht ON ht.id = m.home_team_id JOIN t aw ON aw.id = m.away_team_id
"""

# Ids that a load gives: leagues numbered in code order.
NUMBERED = "nc AS (SELECT id, code, ROW_NUMBER() OVER (ORDER BY code)::BIGINT AS new_id FROM c)"

MONTH = "CASE {} " + " ".join(
    f"WHEN {number} THEN '{name}'"
    for number, name in enumerate(
        ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"], 1
    )
) + " END"


def stored_matches(columns: str) -> str:
    return f"SELECT {columns} FROM m JOIN nc ON nc.id = m.competition_id"


SUMMARY = f"""
SELECT COUNT(*) AS matches, {r2("SUM(total_goals)")} AS avg_goals,
       {pct("SUM(home_win)")} AS home_win_pct, {pct("SUM(away_win)")} AS away_win_pct,
       {pct("SUM(is_draw)")} AS draw_pct, {pct("SUM(high_scoring)")} AS high_scoring_pct,
       {big("SUM(both_teams_scored)")} AS btts
FROM m JOIN c ON c.id = m.competition_id
"""

TABLE_ROWS = """
tr AS (
  SELECT competition, code AS competition_code, team, COUNT(*) AS played,
         SUM(w)::BIGINT AS won, SUM(d)::BIGINT AS drawn, SUM(l)::BIGINT AS lost,
         SUM(gf)::BIGINT AS gf, SUM(ga)::BIGINT AS ga, (SUM(gf) - SUM(ga))::BIGINT AS gd,
         (SUM(w) * 3 + SUM(d))::BIGINT AS pts
  FROM a WHERE {where} GROUP BY competition, code, team),
st AS (
  SELECT RANK() OVER (PARTITION BY competition ORDER BY pts DESC, gd DESC, gf DESC)::BIGINT
             AS position, * FROM tr)
"""


def table_rows(where: str = "TRUE") -> str:
    return TABLE_ROWS.strip().format(where=where)


def form(window: int, where: str = "TRUE") -> str:
    return f"""
fr AS (
  SELECT *, CASE WHEN w = 1 THEN 'W' WHEN d = 1 THEN 'D' ELSE 'L' END AS result,
         ROW_NUMBER() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rn
  FROM a WHERE {where}),
fm AS (
  SELECT team, string_agg(result, '' ORDER BY match_date, match_id) AS form,
         SUM(w)::BIGINT AS wins, SUM(d)::BIGINT AS draws, SUM(l)::BIGINT AS losses,
         (SUM(w) * 3 + SUM(d))::BIGINT AS points
  FROM fr WHERE rn <= {window} GROUP BY team HAVING COUNT(*) = {window})
""".strip()


SPLITS = f"""
sp AS (
  SELECT c.name AS competition, COUNT(*) AS matches, {pct("SUM(home_win)")} AS home_win_pct,
         {pct("SUM(away_win)")} AS away_win_pct, {pct("SUM(is_draw)")} AS draw_pct,
         {r2("SUM(total_goals)")} AS avg_goals
  FROM m JOIN c ON c.id = m.competition_id WHERE {{where}} GROUP BY c.name)
""".strip()


def scorers(where: str, limit: int) -> str:
    home, away = ("SUM(gf) FILTER (venue = '{}')".format(v) for v in ("home", "away"))
    home_n, away_n = ("COUNT(*) FILTER (venue = '{}')".format(v) for v in ("home", "away"))
    return f"""
sc AS (
  SELECT team_id, team, {r2("SUM(gf)")} AS avg_goals, {r2(home, home_n)} AS avg_home,
         {r2(away, away_n)} AS avg_away, SUM(gf)::BIGINT AS total_goals, COUNT(*) AS played
  FROM a WHERE {where} GROUP BY team_id, team),
ts AS (SELECT * FROM sc WHERE played >= 5 ORDER BY avg_goals DESC, team_id LIMIT {limit})
""".strip()


def density(where: str = "TRUE") -> str:
    return f"""
rd AS (
  SELECT *, (match_date - LAG(match_date) OVER (
             PARTITION BY team_id ORDER BY match_date, match_id))::BIGINT AS rest_days
  FROM a WHERE {where}),
rb AS (
  SELECT *, CASE WHEN rest_days < 4 THEN 'Congested (<4d)'
                 WHEN rest_days >= 6 THEN 'Rested (6+d)' END AS rest_band FROM rd),
sd AS (
  SELECT competition, rest_band, COUNT(*) AS matches, {pct("SUM(w)")} AS win_pct,
         {r2("SUM(w * 3 + d)")} AS ppg, {r2("SUM(gf)")} AS avg_goals_for
  FROM rb WHERE rest_band IS NOT NULL GROUP BY competition, rest_band)
""".strip()


def bounce(limit: int, where: str = "TRUE") -> str:
    return f"""
sq AS (
  SELECT *, LAG(l) OVER (PARTITION BY team_id ORDER BY match_date, match_id) AS preceded_by_loss
  FROM a WHERE {where}),
bl AS (SELECT team_id, COUNT(*) AS bn, SUM(points) AS bs FROM a WHERE {where} GROUP BY team_id),
af AS (
  SELECT competition, team, sq.team_id, COUNT(*) AS k, SUM(points) AS s,
         (200 * bs + bn) // (2 * bn) AS cents
  FROM sq JOIN bl ON bl.team_id = sq.team_id WHERE preceded_by_loss = 1
  GROUP BY competition, team, sq.team_id, bs, bn HAVING COUNT(*) >= 3),
bb AS (
  SELECT competition, team, k AS games_after_loss, {r2("s", "k")} AS bounce_back_ppg,
         CAST(cents AS DOUBLE) / 100 AS overall_ppg,
         CAST(SIGN(100 * s - k * cents) * ((2 * ABS(100 * s - k * cents) + k) // (2 * k))
              AS DOUBLE) / 100 AS resilience_delta
  FROM af ORDER BY bounce_back_ppg DESC, resilience_delta DESC, team_id, competition
  LIMIT {limit})
""".strip()


BALANCE = """
rp AS (
  SELECT *, ROW_NUMBER() OVER s AS matchweek,
         (SUM(points) OVER (PARTITION BY code, team_id ORDER BY match_date, match_id
                            ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative_points
  FROM a WINDOW s AS (PARTITION BY code, team_id ORDER BY match_date, match_id)),
cb AS (
  SELECT competition, matchweek, COUNT(*) AS teams,
         FLOOR(SQRT(CAST(COUNT(*) * SUM(cumulative_points * cumulative_points)
                         - SUM(cumulative_points) * SUM(cumulative_points) AS DOUBLE))
               / COUNT(*) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS points_stdev
  FROM rp GROUP BY competition, code, matchweek HAVING COUNT(*) >= 2)
""".strip()


TIERS = """
atk AS (
  SELECT code AS competition_code, team_id,
         RANK() OVER (PARTITION BY code ORDER BY SUM(gf) / COUNT(*) DESC)::BIGINT AS attack_rank,
         COUNT(*) OVER (PARTITION BY code) AS league_size
  FROM a GROUP BY code, team_id),
gr AS (
  SELECT a.*, CASE WHEN attack_rank <= 5 THEN 'top'
                   WHEN attack_rank > league_size - 5 THEN 'bottom' END AS opponent_tier
  FROM a JOIN atk ON atk.competition_code = a.code AND atk.team_id = a.opponent_id)
""".strip()


def solidity(limit: int, where: str = "TRUE") -> str:
    def side(expr: str, tier: str) -> str:
        return f"{expr} FILTER (opponent_tier = '{tier}')"

    top_n = side("COUNT(*)", "top")
    return TIERS + f""",
ds AS (
  SELECT competition, team, team_id, {top_n} AS games_vs_top,
         {r2(side("SUM(ga)", "top"), top_n)} AS conceded_vs_top,
         {r2(side("SUM(ga)", "bottom"), side("COUNT(*)", "bottom"))} AS conceded_vs_bottom,
         {pct(side("SUM((ga = 0)::INT)", "top"), top_n)} AS clean_sheet_pct_vs_top
  FROM gr WHERE opponent_tier IS NOT NULL AND {where}
  GROUP BY team_id, team, competition HAVING {top_n} >= 2),
dl AS (SELECT * EXCLUDE (team_id) FROM ds
       ORDER BY conceded_vs_top, clean_sheet_pct_vs_top DESC, team_id, competition LIMIT {limit})
"""


NAMED_MATCHES = """
nm AS (
  SELECT m.*, ht.name AS home_team, aw.name AS away_team, c.name AS competition
  FROM m JOIN t ht ON ht.id = m.home_team_id JOIN t aw ON aw.id = m.away_team_id
  JOIN c ON c.id = m.competition_id)
""".strip()

CLEAN_SHEETS = """
SELECT team, clean_sheets FROM (
  SELECT team, team_id, COUNT(*) AS clean_sheets FROM a WHERE clean_sheet = 1
  GROUP BY team, team_id ORDER BY clean_sheets DESC, team_id LIMIT 10)
"""

MONTHS = f"""
mo AS (
  SELECT match_month AS month, COUNT(*) AS matches, {r2("SUM(total_goals)")} AS avg_goals,
         SUM(total_goals)::BIGINT AS total_goals
  FROM m GROUP BY match_month)
""".strip()

EFFICIENCY = f"""
ef AS (
  SELECT competition, code, team, COUNT(*) AS played, {r2("SUM(gf)")} AS goals_for_pg,
         {r2("SUM(ga)")} AS goals_against_pg, {r2("SUM(points)")} AS points_pg
  FROM a GROUP BY team_id, team, competition, code HAVING COUNT(*) >= 5)
""".strip()

EFFICIENCY_COLUMNS = "competition, team, played, goals_for_pg, goals_against_pg, points_pg"

MATCH_COLUMNS = ", ".join(f"m.{name}" for name in MATCHES.names[4:-1])

ORACLES: dict[str, str] = {
    # Sources and sinks
    "read_matches_json": sql(FLAT),
    "union_leagues": sql(
        "SELECT code, COUNT(*) AS matches, SUM(match_id)::BIGINT AS id_sum "
        "FROM f JOIN c ON c.id = f.competition_id WHERE code <> 'MI' GROUP BY code"
    ),
    "league_scope": sql(
        "SELECT match_id AS id, code, status FROM f JOIN c ON c.id = f.competition_id "
        "WHERE code = 'EU'"
    ),
    "season_scope": sql(
        "SELECT match_id AS id, '1998-01-01' AS season_start FROM f "
        "WHERE EXTRACT(YEAR FROM match_date) = 1998"
    ),
    "load_tables": sql(
        stored_matches(
            "m.match_id AS id, nc.new_id AS competition_id, m.home_team_id, m.away_team_id, "
            f"{MATCH_COLUMNS}, 'Referee ' || (m.match_id % 7) AS referee"
        ),
        NUMBERED,
    ),
    "load_metrics": sql(f"SELECT match_id, {', '.join(METRICS)} FROM m"),
    "load_atomicity": sql(
        stored_matches("m.match_id AS id, nc.new_id AS competition_id")
        + " WHERE m.match_id % 2 = 0",
        NUMBERED,
    ),
    "write_league_snapshot": sql(
        """
        SELECT code AS league, day AS snapshot_date, COUNT(*) AS matches,
               SUM(match_id)::BIGINT AS id_sum, 1::BIGINT AS top_competition_id
        FROM (SELECT code, match_id, DATE '2026-08-13' AS day FROM m
              JOIN c ON c.id = m.competition_id
              WHERE code <> 'AF' OR match_id % 2 = 0
              UNION ALL
              SELECT code, match_id, DATE '2026-08-14' FROM m
              JOIN c ON c.id = m.competition_id WHERE code = 'AF')
        GROUP BY code, day
        """
    ),
    "read_league_snapshots": sql(
        "SELECT code AS league, match_id AS id, home_score_ft, away_score_ft "
        "FROM m JOIN c ON c.id = m.competition_id WHERE code <> 'MI'"
    ),
    "skip_empty_run": sql(
        "SELECT COUNT(*) AS stored, COUNT(*) AS matches, COUNT(*) AS inserted "
        "FROM m JOIN c ON c.id = m.competition_id WHERE code = 'ZZ'"
    ),
    "sql_read": sql(
        "SELECT code, team, COUNT(*) AS home_games FROM a WHERE code = 'AS' AND venue = 'home' "
        "GROUP BY code, team ORDER BY home_games DESC, team LIMIT 7"
    ),
    # Clean and derive
    "unreadable_responses": sql(
        f"SELECT COUNT(*) FILTER (match_id % 10 <> 3) AS matches, "
        f"{big('SUM(match_id) FILTER (match_id % 10 <> 3)')} AS id_sum, "
        f"COUNT(*) FILTER (match_id % 10 = 3) AS unreadable FROM ({FLAT})"
    ),
    "compact_store": sql(
        stored_matches(
            "m.match_id AS id, m.home_team_id, m.away_team_id, "
            f"{MATCH_COLUMNS}, 'Referee ' || (m.match_id % 7) AS referee"
        ),
        NUMBERED,
    ),
    "normalize_matches": sql(FLAT),
    "completed_filter": sql(
        "SELECT match_id, status FROM f WHERE status IN ('FINISHED', 'AWARDED')"
    ),
    "drop_incomplete": sql(
        "SELECT match_id, home_score_ft::VARCHAR AS home_score_ft, "
        "away_score_ft::VARCHAR AS away_score_ft FROM f "
        "WHERE match_id % 13 <> 0 AND match_id % 17 <> 0 AND match_id % 19 <> 0"
    ),
    "coerce_scores": sql(
        "SELECT match_id, CASE WHEN match_id % 7 = 0 THEN 0 ELSE home_score_ft END "
        "AS home_score_ft, away_score_ft, COALESCE(home_score_ht, 0) AS home_score_ht, "
        "COALESCE(away_score_ht, 0) AS away_score_ht FROM f"
    ),
    "dedupe_matches": sql("SELECT match_id, home_score_ft, away_score_ft FROM f"),
    "parse_utc_date": sql(
        """
        SELECT match_id, EPOCH(instant)::BIGINT AS seconds, CAST(instant AS DATE) AS day
        FROM (SELECT match_id, CASE WHEN match_id % 5 = 0 THEN NULL
                     WHEN match_id % 3 = 0 THEN utc_date + INTERVAL 3 HOUR
                     ELSE utc_date END AS instant FROM f)
        """
    ),
    "transform_matches": sql(TRANSFORMED),
    "match_date": sql("SELECT match_id, match_date FROM m"),
    **{name: sql(f"SELECT match_id, {name} FROM m") for name in METRICS},
    "month_name": sql(f"SELECT match_id, {MONTH.format('match_month')} AS month_name FROM m"),
    "extract_teams": sql(
        """
        SELECT team_id, CASE WHEN BOOL_OR(venue = 'home') THEN team
                             ELSE team || ' (away)' END AS team_name
        FROM a GROUP BY team_id, team
        """
    ),
    "extract_competitions": sql(
        "SELECT new_id AS id, nc.code, CASE WHEN MIN(match_id) < 1000 THEN c.name "
        "ELSE c.name || '!' END AS name FROM m JOIN c ON c.id = m.competition_id "
        "JOIN nc ON nc.code = c.code GROUP BY new_id, nc.code, c.name",
        NUMBERED,
    ),
    "run_summary": sql(
        "SELECT (SELECT COUNT(*) FROM m) AS matches, COUNT(DISTINCT team_id) AS teams, "
        "COUNT(DISTINCT code) AS competitions FROM a"
    ),
    # Idempotent load
    "upsert_competitions": sql(
        """
        SELECT CASE code WHEN 'AF' THEN 3 ELSE 7 END::BIGINT AS id, code, name || ' (old)' AS name
        FROM c WHERE code IN ('AF', 'EU')
        UNION ALL
        SELECT 7 + ROW_NUMBER() OVER (ORDER BY code), code, name
        FROM c WHERE code NOT IN ('AF', 'EU')
        """
    ),
    "upsert_teams": sql(
        "SELECT id, CASE WHEN id % 2 = 0 THEN name || ' (old)' ELSE name END AS name FROM t"
    ),
    "insert_new_matches": sql(
        "SELECT match_id AS id, competition_id, CASE WHEN match_id % 2 = 0 "
        "THEN home_score_ft + 1 ELSE home_score_ft END AS home_score_ft FROM m"
    ),
    "insert_new_metrics": sql(
        "SELECT match_id, CASE WHEN match_id % 2 = 0 THEN 9 ELSE total_goals END AS total_goals, "
        "CASE WHEN match_id % 2 = 0 THEN 9 ELSE home_win END AS home_win FROM m "
        "WHERE match_id % 2 = 0 OR match_id % 3 <> 0"
    ),
    "key_checks": sql(
        """
        SELECT COUNT(*) FILTER (match_id % 101 = 0) AS match_id,
               COUNT(*) FILTER (match_id % 11 = 0) AS competition_code,
               0::BIGINT AS competition_name, COUNT(*) FILTER (match_id % 7 = 0) AS home_team_id,
               0::BIGINT AS away_team_id, 0::BIGINT AS home_team_name, 0::BIGINT AS away_team_name
        FROM m
        """
    ),
    "orphan_checks": sql(
        """
        SELECT COUNT(*) FILTER (match_id % 5 = 0) AS no_match,
               COUNT(*) FILTER (match_id % 5 <> 0 AND code = 'AS') AS no_competition,
               COUNT(*) FILTER (match_id % 5 <> 0 AND home_team_id % 7 = 0) AS no_home_team,
               COUNT(*) FILTER (match_id % 5 <> 0 AND away_team_id % 7 = 0) AS no_away_team
        FROM m JOIN c ON c.id = m.competition_id
        """
    ),
    # Snapshot merge
    "merge_competitions": sql(
        "SELECT ROW_NUMBER() OVER (ORDER BY (id + 2) % 5)::BIGINT AS id, code, name FROM c"
    ),
    "merge_teams": sql(
        "SELECT id, CASE WHEN id % 3 = 0 THEN name || ' (new)' ELSE name END AS name FROM t"
    ),
    "merge_matches": sql(
        f"""
        SELECT m.match_id AS id, fresh.new_id AS competition_id, m.home_team_id, m.away_team_id,
               {", ".join(f"m.{name}" for name in MATCHES.names[4:7])},
               CASE WHEN match_id % 4 <> 0 THEN home_score_ft + 1 ELSE home_score_ft END
                   AS home_score_ft,
               {", ".join(f"m.{name}" for name in MATCHES.names[8:12])},
               NULL::VARCHAR AS referee
        FROM m JOIN (SELECT id, ROW_NUMBER() OVER (ORDER BY (id + 2) % 5)::BIGINT AS new_id FROM c)
             fresh ON fresh.id = m.competition_id
        """
    ),
    "merge_metrics": sql(
        "SELECT match_id, CASE WHEN match_id % 4 <> 0 THEN total_goals + 1 "
        "ELSE total_goals END AS total_goals, home_win FROM m"
    ),
    "merge_league_snapshots": sql(
        """
        SELECT ROW_NUMBER() OVER (ORDER BY code)::BIGINT AS competition_id,
               code AS competition_code, name AS competition, COUNT(*) AS matches,
               SUM(match_id)::BIGINT AS id_sum, SUM(total_goals)::BIGINT AS goals
        FROM m JOIN c ON c.id = m.competition_id GROUP BY code, name
        """
    ),
    # The core primitive
    "appearances": sql(
        "SELECT competition_id, code AS competition_code, match_id, match_date, matchday, venue, "
        "team_id, opponent_id, gf, ga, w, d, l, points, clean_sheet, btts, high_scoring FROM a"
    ),
    "appearances_without_metrics": sql(
        "SELECT competition_id, competition, code AS competition_code, match_id, match_date, "
        "matchday, venue, team_id, opponent_id, gf, ga FROM a"
    ),
    # Reports
    "competitions": sql(
        "SELECT DISTINCT c.code, c.name FROM c JOIN m ON m.competition_id = c.id"
    ),
    "summary": sql(SUMMARY),
    "summary_league": sql(SUMMARY + " WHERE c.code = 'AF'"),
    "standings": sql("SELECT * FROM st", table_rows()),
    "standings_league": sql("SELECT * FROM st", table_rows("code = 'EU'")),
    "standings_through_matchday": sql("SELECT * FROM st", table_rows("matchday <= 12")),
    "matchday_bounds": sql("SELECT MIN(matchday) AS lo, MAX(matchday) AS hi FROM m"),
    "matchday_bounds_none": sql(
        "SELECT COALESCE(MIN(matchday), 1) AS lo, COALESCE(MAX(matchday), 1) AS hi "
        "FROM m JOIN c ON c.id = m.competition_id WHERE code = 'ZZ'"
    ),
    "team_form": sql("SELECT * FROM fm", form(5)),
    "team_form_3": sql("SELECT * FROM fm", form(3, "code = 'AM'")),
    "home_away_splits": sql("SELECT * FROM sp", SPLITS.format(where="TRUE")),
    "home_away_splits_missing_metrics": sql(
        "SELECT * FROM sp", SPLITS.format(where="match_id % 101 <> 0")
    ),
    "top_scoring_teams": sql("SELECT * EXCLUDE (team_id) FROM ts", scorers("TRUE", 10)),
    "top_scoring_teams_league": sql(
        "SELECT * EXCLUDE (team_id) FROM ts", scorers("code = 'AS'", 5)
    ),
    "goals_by_month": sql(
        f"SELECT month, {MONTH.format('month')} AS month_name, matches, avg_goals, total_goals "
        "FROM mo",
        MONTHS,
    ),
    "high_scoring_matches": sql(
        "SELECT match_date AS date, home_team, home_score_ft AS home_goals, "
        "away_score_ft AS away_goals, away_team, total_goals, competition FROM nm "
        "ORDER BY total_goals DESC, match_date DESC, match_id DESC LIMIT 10",
        NAMED_MATCHES,
    ),
    "clean_sheet_leaders": sql(CLEAN_SHEETS),
    "schedule_density": sql("SELECT * FROM sd", density()),
    "schedule_density_league": sql("SELECT * FROM sd", density("code = 'MI'")),
    "bounce_back": sql("SELECT * FROM bb", bounce(10)),
    "bounce_back_league": sql("SELECT * FROM bb", bounce(1000, "code = 'AF'")),
    "competitive_balance": sql("SELECT * FROM cb", BALANCE),
    "efficiency_matrix": sql(f"SELECT {EFFICIENCY_COLUMNS} FROM ef", EFFICIENCY),
    "defensive_solidity": sql("SELECT * FROM dl", solidity(10).strip()),
    "defensive_solidity_league": sql("SELECT * FROM dl", solidity(1000, "code = 'EU'").strip()),
    # Pieces of the reports
    "recent_matches": sql(
        "SELECT team_id, match_id, recency FROM (SELECT team_id, match_id, ROW_NUMBER() OVER ("
        "PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS recency FROM a) "
        "WHERE recency <= 4"
    ),
    "rest_days": sql("SELECT team_id, match_id, rest_days FROM rd", density()),
    "rest_band": sql("SELECT team_id, match_id, rest_band FROM rb", density()),
    "preceded_by_loss": sql("SELECT team_id, match_id, preceded_by_loss FROM sq", bounce(10)),
    "baseline_ppg": sql(
        f"SELECT team_id, {r2('SUM(points)')} AS overall_ppg FROM a GROUP BY team_id"
    ),
    "running_points": sql(
        "SELECT code AS competition_code, team_id, match_id, matchweek, cumulative_points FROM rp",
        BALANCE,
    ),
    "attack_tier": sql("SELECT * FROM atk", TIERS),
    "opponent_grade": sql(
        "SELECT code AS competition_code, match_id, team_id, opponent_id, ga AS conceded, "
        "opponent_tier FROM gr WHERE opponent_tier IS NOT NULL",
        TIERS,
    ),
    "venue_average": sql("SELECT * EXCLUDE (team) FROM sc", scorers("TRUE", 10)),
    # Stand-alone reports
    "sql_standings": sql(
        "SELECT competition, team AS team_name, played AS MP, won AS W, drawn AS D, lost AS L, "
        "gf AS GF, ga AS GA, gd AS GD, pts AS Pts FROM tr",
        table_rows(),
    ),
    "sql_top_scoring": sql(
        "SELECT team, avg_goals AS avg_goals_per_game, total_goals, played AS matches_played "
        "FROM ts",
        scorers("TRUE", 10),
    ),
    "sql_high_scoring": sql(
        "SELECT match_date, home_team, home_score_ft, away_score_ft, away_team, total_goals, "
        "competition FROM nm ORDER BY total_goals DESC, match_date DESC, match_id DESC LIMIT 20",
        NAMED_MATCHES,
    ),
    "sql_clean_sheets": sql(CLEAN_SHEETS),
    "outcome_rates": sql(
        f"""
        SELECT COUNT(*) AS total_matches, {big("SUM(home_win)")} AS home_wins,
               {big("SUM(away_win)")} AS away_wins, {big("SUM(is_draw)")} AS draws,
               {pct("SUM(home_win)")} AS home_win_pct, {pct("SUM(away_win)")} AS away_win_pct,
               {pct("SUM(is_draw)")} AS draw_pct, {r2("SUM(total_goals)")} AS avg_goals_per_game
        FROM m
        """
    ),
    "sql_goals_by_month": sql("SELECT * FROM mo", MONTHS),
    "comeback_wins": sql(
        "SELECT home_team, home_score_ht, away_score_ht, home_score_ft, away_score_ft, away_team, "
        "match_date FROM nm WHERE comeback_home = 1 OR comeback_away = 1 "
        "ORDER BY match_date DESC, match_id DESC LIMIT 20",
        NAMED_MATCHES,
    ),
    "team_performance_summary": sql(
        f"""
        SELECT team, COUNT(*) AS played, {big("SUM(w)")} AS wins, {big("SUM(d)")} AS draws,
               {big("SUM(l)")} AS losses, {big("SUM(gf)")} AS goals_for,
               {big("SUM(ga)")} AS goals_against, {big("SUM(gf) - SUM(ga)")} AS goal_diff,
               {big("SUM(w) * 3 + SUM(d)")} AS points, {big("SUM(clean_sheet)")} AS clean_sheets,
               {big("SUM(btts)")} AS both_scored_games, {pct("SUM(w)")} AS win_pct
        FROM a GROUP BY team_id, team
        """
    ),
    # Shaping
    "standings_top_n": sql(
        "SELECT * EXCLUDE (line) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY competition "
        "ORDER BY position, competition_code, team) AS line FROM st) WHERE line <= 3",
        table_rows(),
    ),
    "form_top": sql("SELECT * FROM fm ORDER BY points DESC, wins DESC, team LIMIT 15", form(5)),
    "rest_band_pivot": sql(
        """
        SELECT competition,
               MAX(win_pct) FILTER (rest_band = 'Congested (<4d)') AS "Congested (<4d)",
               MAX(win_pct) FILTER (rest_band = 'Rested (6+d)') AS "Rested (6+d)"
        FROM sd GROUP BY competition
        """,
        density(),
    ),
    "parity_pivot": sql(
        "SELECT matchweek, "
        + ", ".join(
            f"MAX(points_stdev) FILTER (competition = '{name}') AS \"{name}\""
            for name in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
        )
        + " FROM cb GROUP BY matchweek",
        BALANCE,
    ),
    "splits_chart": sql(
        'SELECT competition, home_win_pct AS "Home win %", away_win_pct AS "Away win %", '
        'draw_pct AS "Draw %" FROM sp',
        SPLITS.format(where="TRUE"),
    ),
    "kpi_format": sql(
        """
        SELECT format('{:,}', matches) AS matches, printf('%.2f', avg_goals) AS avg_goals,
               CAST(round_even(home_win_pct, 0) AS BIGINT) || '%' AS home_wins,
               CAST(round_even(away_win_pct, 0) AS BIGINT) || '%' AS away_wins,
               CAST(round_even(draw_pct, 0) AS BIGINT) || '%' AS draws
        FROM sm
        """,
        f"sm AS ({SUMMARY})",
    ),
    "standings_view": sql(
        'SELECT competition, position AS "Pos", team AS "Team", played AS "P", won AS "W", '
        'drawn AS "D", lost AS "L", gf AS "GF", ga AS "GA", gd AS "GD", pts AS "Pts" FROM st',
        table_rows(),
    ),
    "form_view": sql(
        'SELECT team AS "Team", form AS "Form", wins AS "W", draws AS "D", losses AS "L", '
        'points AS "Pts" FROM fm ORDER BY points DESC, wins DESC, team LIMIT 15',
        form(5),
    ),
    "bounce_back_view": sql(
        'SELECT competition AS "League", team AS "Team", games_after_loss AS "Games", '
        'bounce_back_ppg AS "PPG after loss", overall_ppg AS "Baseline PPG", '
        'resilience_delta AS "Δ" FROM bb',
        bounce(10),
    ),
    "solidity_view": sql(
        'SELECT competition AS "League", team AS "Team", games_vs_top AS "Games vs top 5", '
        'conceded_vs_top AS "Conceded vs top 5", conceded_vs_bottom AS "Conceded vs bottom 5", '
        'clean_sheet_pct_vs_top AS "Clean sheet % vs top 5" FROM dl',
        solidity(10).strip(),
    ),
    "league_code_for_name": sql("SELECT code FROM c WHERE name = 'MIDDLE EAST'"),
    "report": sql("SELECT * FROM cb WHERE competition = 'EUROPE'", BALANCE),
    "cached_reports": sql(
        f"SELECT {EFFICIENCY_COLUMNS} FROM ef", EFFICIENCY
    ),
    "console_report": sql(
        """
        SELECT 'LEAGUE STANDINGS' AS section, COUNT(*) AS rows,
               string_agg(DISTINCT competition, ',' ORDER BY competition) AS names,
               SUM(pts)::BIGINT AS total
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY competition
                                           ORDER BY position, team) AS line
              FROM st) WHERE line <= 10
        UNION ALL SELECT 'RECENT FORM (last 5)', COUNT(*),
               string_agg(DISTINCT team, ',' ORDER BY team), SUM(points)::BIGINT
        FROM (SELECT * FROM fm ORDER BY points DESC, wins DESC, team LIMIT 15)
        UNION ALL SELECT 'HOME vs AWAY SPLITS', COUNT(*),
               string_agg(DISTINCT competition, ',' ORDER BY competition), SUM(matches)::BIGINT
        FROM sp
        UNION ALL SELECT 'TOP SCORING TEAMS (avg goals / match)', COUNT(*),
               string_agg(DISTINCT team, ',' ORDER BY team), SUM(total_goals)::BIGINT
        FROM ts
        UNION ALL SELECT 'SCORING BY MONTH', COUNT(*),
               string_agg(month_name, ',' ORDER BY month_name), SUM(total_goals)::BIGINT
        FROM (SELECT *, """ + MONTH.format("month") + """ AS month_name FROM mo)
        """,
        table_rows(), form(5), SPLITS.format(where="TRUE"), scorers("TRUE", 10), MONTHS,
    ),
    "round_robin_fixtures": sql(
        """
        SELECT competition, COUNT(DISTINCT team_id) AS teams,
               COUNT(DISTINCT team_id) * (COUNT(DISTINCT team_id) - 1) AS expected_pairs,
               COUNT(DISTINCT (team_id, opponent_id)) FILTER (venue = 'home') AS played_pairs,
               expected_pairs - played_pairs AS missing_pairs
        FROM a GROUP BY competition
        """
    ),
}

# Reports by name, over all leagues.
REPORT_NAMES = {
    "summary": "summary", "standings": "standings", "efficiency": "efficiency_matrix",
    "form": "team_form", "splits": "home_away_splits", "fatigue": "schedule_density",
    "resilience": "bounce_back", "parity": "competitive_balance", "defense": "defensive_solidity",
}
ORACLES.update({f"report_{name}": ORACLES[same] for name, same in REPORT_NAMES.items()})

# Averages over known values: the same tables with unknown and negative scores.
UNKNOWN = BASE.strip().replace("\nm AS (", "\nm0 AS (", 1).replace("\na AS (", """
m AS (
  SELECT * REPLACE (
    CASE WHEN match_id % 7 <> 3 THEN CASE WHEN match_id % 13 = 5 THEN -2 ELSE home_score_ft END END
        AS home_score_ft,
    CASE WHEN match_id % 11 <> 4 THEN away_score_ft END AS away_score_ft,
    CASE WHEN match_id % 7 <> 3 AND match_id % 11 <> 4
         THEN CASE WHEN match_id % 13 = 5 THEN -total_goals ELSE total_goals END END AS total_goals,
    CASE WHEN match_id % 19 <> 6 THEN is_draw END AS is_draw)
  FROM m0),
a AS (""", 1)


def unknown(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([UNKNOWN, *ctes]) + "\n" + body


def avg(value: str, where: str = "TRUE", scale: int = 100) -> str:
    """The average of known values; halves away from zero."""
    total, n = f"SUM({value}) FILTER ({where})", f"COUNT({value}) FILTER ({where})"
    return (f"CAST(SIGN({total}) * (({2 * scale} * ABS({total}) + {n}) // (2 * NULLIF({n}, 0))) AS DOUBLE)"
            f" / {scale}")


RATES = ", ".join(f"{pct(f'SUM({flag})')} AS {name}" for flag, name in (
    ("home_win", "home_win_pct"), ("away_win", "away_win_pct"), ("is_draw", "draw_pct")))
KNOWN_MONTHS = f"""
SELECT match_month AS month, {{}} COUNT(*) AS matches, {avg("total_goals")} AS avg_goals,
       SUM(total_goals)::BIGINT AS total_goals FROM m GROUP BY match_month
"""
POINTS = "CASE WHEN w = 1 THEN 3 WHEN d = 1 THEN 1 ELSE 0 END"

ORACLES.update({
    "summary_unknown_scores": unknown(
        f"SELECT COUNT(*) AS matches, {avg('total_goals')} AS avg_goals, {RATES}, "
        f"{pct('SUM(high_scoring)')} AS high_scoring_pct, {big('SUM(both_teams_scored)')} AS btts FROM m"),
    "standings_unknown_scores": unknown("SELECT * FROM st", table_rows()),
    "home_away_splits_unknown_scores": unknown(
        f"SELECT c.name AS competition, COUNT(*) AS matches, {RATES}, {avg('total_goals')} AS avg_goals "
        "FROM m JOIN c ON c.id = m.competition_id GROUP BY c.name"),
    "goals_by_month_unknown_scores": unknown(
        KNOWN_MONTHS.format(MONTH.format("match_month") + " AS month_name,")),
    "sql_goals_by_month_unknown_scores": unknown(KNOWN_MONTHS.format("")),
    "outcome_rates_unknown_scores": unknown(
        f"SELECT COUNT(*) AS total_matches, {big('SUM(home_win)')} AS home_wins, "
        f"{big('SUM(away_win)')} AS away_wins, {big('SUM(is_draw)')} AS draws, {RATES}, "
        f"{avg('total_goals')} AS avg_goals_per_game FROM m"),
    "schedule_density_unknown_scores": unknown(
        f"SELECT competition, rest_band, COUNT(*) AS matches, {pct('SUM(w)')} AS win_pct, "
        f"{avg('w * 3 + d')} AS ppg, {avg('gf')} AS avg_goals_for "
        "FROM rb WHERE rest_band IS NOT NULL GROUP BY competition, rest_band", density()),
    "efficiency_matrix_unknown_scores": unknown(
        f"SELECT competition, team, COUNT(*) AS played, {avg('gf')} AS goals_for_pg, "
        f"{avg('ga')} AS goals_against_pg, {avg(POINTS)} AS points_pg "
        "FROM a GROUP BY team_id, team, competition HAVING COUNT(*) >= 5"),
    "defensive_solidity_unknown_scores": unknown(
        f"""
        SELECT competition, team, COUNT(*) FILTER (opponent_tier = 'top') AS games_vs_top,
               {avg('ga', "opponent_tier = 'top'")} AS conceded_vs_top,
               {avg('ga', "opponent_tier = 'bottom'")} AS conceded_vs_bottom,
               {avg('100 * (ga = 0)::INT', "opponent_tier = 'top'", 10)} AS clean_sheet_pct_vs_top
        FROM (SELECT a.*, CASE WHEN attack_rank <= 5 THEN 'top'
                               WHEN attack_rank > league_size - 5 THEN 'bottom' END AS opponent_tier
              FROM a JOIN (
                SELECT code, team_id, COUNT(*) OVER (PARTITION BY code) AS league_size,
                       RANK() OVER (PARTITION BY code ORDER BY SUM(gf) / COUNT(gf) DESC NULLS LAST)
                           AS attack_rank
                FROM a GROUP BY code, team_id) k ON k.code = a.code AND k.team_id = a.opponent_id)
        WHERE opponent_tier IS NOT NULL GROUP BY competition, team, team_id
        HAVING COUNT(*) FILTER (opponent_tier = 'top') >= 2
        ORDER BY conceded_vs_top NULLS FIRST, clean_sheet_pct_vs_top DESC NULLS LAST, team_id, competition
        LIMIT 1000
        """),
    "top_scoring_teams_unknown_scores": unknown(
        f"""
        SELECT * EXCLUDE (team_id) FROM (
          SELECT team_id, team, {avg('gf')} AS avg_goals, {avg('gf', "venue = 'home'")} AS avg_home,
                 {avg('gf', "venue = 'away'")} AS avg_away, SUM(gf)::BIGINT AS total_goals, COUNT(*) AS played
          FROM a GROUP BY team_id, team HAVING COUNT(*) >= 5)
        ORDER BY avg_goals DESC NULLS LAST, team_id LIMIT 10
        """),
})

BY_ID = "m JOIN nc ON nc.id = m.competition_id"
ORACLES.update({
    "interleaved_loads": sql(
        f"SELECT match_id AS id, CASE WHEN match_id % 10 = 7 THEN home_score_ft + 1 ELSE home_score_ft END "
        f"AS home_score_ft FROM {BY_ID}", NUMBERED),
    "concurrent_loads": sql(
        """
        SELECT match_id AS id, code AS competition_code,
               CASE code WHEN 'AF' THEN 1 WHEN 'MI' THEN 2 WHEN 'AM' THEN 3 WHEN 'AS' THEN 4 ELSE 5 END::BIGINT
                   AS number,
               CASE WHEN match_id % 3 = 0 AND code IN ('MI', 'AF') THEN home_score_ft + 1 ELSE home_score_ft END
                   AS home_score_ft
        FROM m JOIN c ON c.id = m.competition_id WHERE code <> 'MI' OR match_id % 3 = 0
        """),
    "stream_unreadable": sql(
        "SELECT COUNT(*) FILTER (match_id % 10 <> 3) AS matches, "
        "SUM(match_id) FILTER (match_id % 10 <> 3)::BIGINT AS id_sum, "
        f"(SELECT COUNT(*) FROM ({FLAT}) WHERE match_id % 10 = 3) AS unreadable FROM ({TRANSFORMED})"),
    "league_feed": ORACLES["league_scope"],
    "write_league_snapshot_rerun": sql(
        """
        SELECT match_id AS id, run FROM m JOIN c ON c.id = m.competition_id
        CROSS JOIN (VALUES ('first'), ('second')) r(run)
        WHERE code = 'EU' OR (code = 'AF' AND (run = 'first' OR match_id % 2 = 0))
        """),
    "union_leagues_shared_ids": sql(
        """
        SELECT match_id, first, CASE WHEN code = 'AF' AND match_id % 3 = 0 AND first = 'EU'
                                     THEN home_score_ft + 1 ELSE home_score_ft END AS home_score_ft
        FROM m JOIN c ON c.id = m.competition_id CROSS JOIN (VALUES ('AF'), ('EU')) r(first)
        WHERE code IN ('AF', 'EU')
        """),
    "refreshed_snapshots": sql(
        """
        SELECT match_id AS id, new_id AS competition_id, c.code AS competition_code,
               CASE WHEN c.code = 'EU' OR (c.code = 'AS' AND match_id % 4 = 0) THEN home_score_ft + 1
                    ELSE home_score_ft END AS home_score_ft
        FROM m JOIN c ON c.id = m.competition_id
        JOIN (SELECT code, ROW_NUMBER() OVER (ORDER BY CASE code WHEN 'AF' THEN 1 WHEN 'AM' THEN 2
                     ELSE 4 END, CASE code WHEN 'AS' THEN 1 WHEN 'EU' THEN 2 ELSE 3 END)::BIGINT AS new_id
              FROM c) n ON n.code = c.code
        """),
    "stored_reports": sql(
        "SELECT *, 'after' AS asked FROM (SELECT " + EFFICIENCY_COLUMNS + " FROM ef) UNION ALL "
        "SELECT *, 'before' AS asked FROM (SELECT " + EFFICIENCY_COLUMNS + " FROM eh)",
        EFFICIENCY, EFFICIENCY.replace("ef AS", "eh AS").replace("FROM a GROUP", "FROM a WHERE match_id % 2 = 0 GROUP")),
    "parity_pivot_all": ORACLES["parity_pivot"],
})
