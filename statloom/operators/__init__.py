"""Dataset operators: order, combination, summary, shape and statistics."""
