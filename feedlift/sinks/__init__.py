"""Where rows go: a topic of messages, or a typed table."""
