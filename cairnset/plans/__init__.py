"""Multi-step jobs: persisting and staging."""
