"""DataFrame operators: contract, rules, decision, windows, evaluation, drift, monitoring."""
