"""What a run asks of models and services, and answers that need no network."""
