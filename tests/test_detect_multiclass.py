import oracle
from wirelark.plans import all_queries


def test_no_attack_is_called_benign(spark):
    """On more flows than a bounded fit would read: a forest's mean left some attacks under the threshold."""
    queries, oracles = all_queries()
    sf_dir, name = "/root/testdata/sf0.01", "detect_multiclass"
    assert oracle.compare(name, queries[name], oracles[name], spark, oracle.connect(sf_dir), sf_dir) is None
