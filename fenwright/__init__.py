"""fenwright: operational text analytics, territory planning and corpus building on Spark."""
