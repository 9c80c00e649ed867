"""Plans that combine operators: factors, scores, evaluations."""
