from spokeworks.sources.readers import (
    read_checked_profiles,
    read_payloads,
    read_profiles,
    read_published_sitemaps,
    read_sitemap,
    read_table,
    stream_table,
    write_checked_profiles,
)
from spokeworks.sources.sinks import (
    publish_index,
    publish_robots,
    publish_site,
    publish_sitemaps,
    write_sitemap_xml,
)

__all__ = [
    "publish_index",
    "publish_robots",
    "publish_site",
    "publish_sitemaps",
    "read_checked_profiles",
    "read_payloads",
    "read_profiles",
    "read_published_sitemaps",
    "read_sitemap",
    "read_table",
    "stream_table",
    "write_checked_profiles",
    "write_sitemap_xml",
]
