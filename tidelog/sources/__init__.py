"""Where logs and state are kept: sorted tables, checkpoints, backups, change capture."""
