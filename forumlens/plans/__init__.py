"""Ready-made pipelines and the registered queries."""
