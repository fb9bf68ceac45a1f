"""DataFrame operators: masks, alignment, targets, windows, aggregates, models, sampling, evaluation."""
