"""Adapters: inputs of a kind turned into emissions, and the events that go out after a commit."""
