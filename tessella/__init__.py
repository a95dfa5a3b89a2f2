"""Panel-experiment analytics on Spark: dispersion, contrasts, resampling inference, audits and selection."""
