"""DataFrame operators: cleaning, samples, folds, scoring, views, pixels."""
