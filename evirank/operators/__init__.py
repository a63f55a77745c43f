"""DataFrame-to-DataFrame operators: identity, evidence, features, ranking, metrics, text."""
