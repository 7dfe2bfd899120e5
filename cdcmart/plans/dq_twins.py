"""DuckDB twins of the quality tests, from a statement of their own of what is declared."""

from __future__ import annotations

# FIXED VALUES: per model, column: tests; accepted values in parentheses, the column
# that a reference points to after an arrow.
DECLARED = """
stg_pulls
  id: unique not_null
  player_id: not_null
  banner_id: not_null
  character_id: not_null
  rarity: not_null (SSR, SR, R)
  pulled_at: not_null
stg_transactions
  id: unique not_null
  player_id: not_null
  payment_status: not_null (success, failed, refunded, pending)
  transacted_at: not_null
stg_players
  id: unique not_null
  username: not_null
  region: not_null
stg_player_pity
  id: unique not_null
  player_id: not_null
  banner_type: not_null
stg_player_inventory
  id: unique not_null
  player_id: not_null
  character_id: not_null
stg_characters
  id: unique not_null
  name: not_null
  rarity: not_null (SSR, SR, R)
stg_banners
  id: unique not_null
  name: not_null
  type: not_null (permanent, limited)
fact_pulls
  pull_id: unique not_null
  player_id: not_null
  character_id: not_null -> dim_characters.character_id
  rarity: not_null (SSR, SR, R)
  pulled_at: not_null
fact_transactions
  transaction_id: unique not_null
  player_id: not_null
  payment_status: not_null (success, failed, refunded, pending)
  transacted_at: not_null
dim_players
  player_id: unique not_null
  username: not_null
  region: not_null
dim_characters
  character_id: unique not_null
  rarity: not_null (SSR, SR, R)
  name: not_null
dim_banners
  banner_id: unique not_null
  name: not_null
  type: not_null (permanent, limited)
agg_player_spending
  player_id: unique not_null
  total_pulls: not_null
  total_crystals_spent: not_null
"""

BRONZE = """
bronze_keys
  id: unique not_null -> stg_players.id
  event: (insert, update)
  source_table: not_null
"""


def _failures(model: str, column: str, text: str) -> list[tuple[str, str]]:
    """(test, SQL of its number of failures) of one declared line."""
    rest, _, target = text.partition("->")
    names, _, values = rest.partition("(")
    out = []
    if "unique" in names.split():
        out.append(("unique", f"SELECT count(*) FROM (SELECT count(*) AS n FROM {model} WHERE {column} IS NOT NULL GROUP BY {column}) WHERE n > 1"))
    if "not_null" in names.split():
        out.append(("not_null", f"SELECT count(*) - count({column}) FROM {model}"))
    if values:
        listed = ", ".join(f"'{v.strip()}'" for v in values.strip(" )").split(","))
        out.append(("accepted_values", f"SELECT count(*) FROM (SELECT DISTINCT {column} AS v FROM {model}) WHERE v NOT IN ({listed})"))
    if target:
        parent, key = target.strip().split(".")
        out.append(("relationships", f"SELECT count(*) FROM {model} m ANTI JOIN {parent} p ON m.{column} = p.{key} WHERE m.{column} IS NOT NULL"))
    return out


def twin(declared: str, labels: dict[str, str] | None = None) -> str:
    """One row per declared test; ``labels`` renames models in the result."""
    parts, model = [], ""
    for line in declared.strip().splitlines():
        if not line.startswith(" "):
            model = line.strip()
            continue
        column, _, tests = line.strip().partition(":")
        for test, failures in _failures(model, column, tests):
            parts.append(f"SELECT '{(labels or {}).get(model, model)}' AS model, '{column}' AS \"column\", '{test}' AS test, ({failures}) AS failures")
    return "SELECT *, failures = 0 AS passed FROM (" + "\nUNION ALL ".join(parts) + ")"
