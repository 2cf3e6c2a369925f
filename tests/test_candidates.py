"""What the search for candidates carries."""

from kinfold.operators import transition as T
from kinfold.plans import queries as Q


def test_candidates_carry_no_similarities(spark, sf):
    state = Q.state(spark, sf)
    plan = T.candidates(state)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "exp_sim" not in plan and "theta" not in plan
    both = [sorted(map(tuple, df.select("rec_id", "ent_id").collect())) for df in (T.candidates(state), T.candidate_rows(state))]
    assert both[0] == both[1] and both[0]
