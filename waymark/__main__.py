from waymark.cli import main

raise SystemExit(main())
