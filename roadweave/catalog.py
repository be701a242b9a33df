"""All queries of the road-network operators with their oracle SQL."""

from roadweave.plans import oracle, road

QUERIES = dict(road.QUERIES)
_SAME_ANSWER = {"sp6_bidirectional": "sp2_point_to_point", "sp9_hub_labels": "sp2_point_to_point", "sp15_elimination_tree": "sp2_point_to_point", "k3_bucket_knn": "k1_closest_poi", "g5_sorted_edges": "src1_edges"}
ORACLES = {k: v for k, v in oracle.ORACLES.items() if k in QUERIES} | {k: oracle.ORACLES[v] for k, v in _SAME_ANSWER.items()}
