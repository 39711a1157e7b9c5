"""Reusable distributed operators: global order, exact sampling, quantiles, group completion."""
