"""Request log -> typed plan -> output decisions -> geometry."""
