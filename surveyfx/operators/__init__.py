"""Survey operators: cell totals, descriptives, tests and regressions."""
