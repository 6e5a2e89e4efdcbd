"""DataFrame -> DataFrame operators; every table carries ``run_id``."""
