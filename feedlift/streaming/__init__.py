"""Running the job: triggers, batch writers, checkpoints."""
