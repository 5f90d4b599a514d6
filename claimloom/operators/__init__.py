"""DataFrame -> DataFrame operators; none of them holds a session or a clock."""
