"""Detection pipeline, decoders, corpus recipes and the rate limiter."""
