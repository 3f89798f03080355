"""Product branding written into generated texts (PR titles and bodies, context
META, XML namespace).  Deployments set their own values here; everything
else in those texts is fixed."""

NAME = "findrift"
SITE = "https://example.org/findrift"
SOURCE = "https://example.org/findrift/source"
XML_NS = "urn:findrift:custom-context"
