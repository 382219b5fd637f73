"""Where rows come from: a staged feed of posts, or a topic of messages."""
