from postlab.sources.posts import posts_view, bronze_posts, read_table, load_posts_csv  # noqa: F401
