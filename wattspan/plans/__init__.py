"""End-to-end jobs: training and user-level reads."""
