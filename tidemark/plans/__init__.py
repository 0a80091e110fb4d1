"""How work is laid out on the cluster: series partitioning, staging and whole runs."""
