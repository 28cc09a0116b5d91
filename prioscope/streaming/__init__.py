"""The stateless scoring steps on Structured Streaming."""
